"""Column expressions and small dimension tables."""
