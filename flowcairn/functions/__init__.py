"""Column expressions: numbers, labels, ratios and names."""
