"""Column expressions: time bounds, text patterns, keyed hashing."""
