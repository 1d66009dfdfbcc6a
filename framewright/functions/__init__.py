"""Column expressions: vectors, text, paths and hashes."""
