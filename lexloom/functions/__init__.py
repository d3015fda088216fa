"""Column functions: text, repair, values."""
