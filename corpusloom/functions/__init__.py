"""Column functions: text, similarity, logic. Each takes and returns columns."""
