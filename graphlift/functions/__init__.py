"""Column expressions: naming, type mapping, value conversion."""
