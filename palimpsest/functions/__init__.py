"""Column expressions: text rules and similarity measures."""
