"""Column expressions (set algebra, supports, text forms)."""
