"""Column expressions: text, ranking, colours and JSON. No Python runs for a row."""
