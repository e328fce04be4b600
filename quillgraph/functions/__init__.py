"""Column expressions over properties."""
