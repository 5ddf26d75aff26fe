"""Column expressions and small pure functions."""
