"""Column expressions and their NumPy twins."""
