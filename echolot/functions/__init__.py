"""Functions of source text, and column expressions."""
