"""Column expressions and exact integer functions."""
