"""Column expressions: no user code runs per row."""
