"""Column expressions: cleaning, tokens, similarity, metrics."""
