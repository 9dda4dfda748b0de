"""Column expressions: time arithmetic, SQL text, result sets, text similarity."""
