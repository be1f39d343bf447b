"""Column expressions: text in, text or arrays out."""
