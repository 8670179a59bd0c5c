"""Column functions and sizing rules."""
