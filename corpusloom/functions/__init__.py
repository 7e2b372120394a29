"""Column expressions and pure functions on texts."""
