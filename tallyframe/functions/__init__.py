"""Column expressions and distributed numbering helpers."""
