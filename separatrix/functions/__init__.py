"""Column expressions: text, vectors, link functions and stable hashes."""
