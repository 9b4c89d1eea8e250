"""Readers: rating blocks, raw rating files, text outputs, warehouse fixtures."""
