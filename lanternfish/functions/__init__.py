"""Column expressions: text, identity, URLs."""
