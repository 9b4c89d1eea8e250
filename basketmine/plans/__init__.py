"""Plans: the level loop, runtime settings, shared storage."""
