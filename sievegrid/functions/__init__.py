"""Column expressions and table-valued functions."""
