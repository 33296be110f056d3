"""Column expressions: text, vectors, JSON."""
