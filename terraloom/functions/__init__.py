"""Column expressions over map tags."""
