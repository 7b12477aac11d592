"""Column expressions: versions, names, value checks."""
