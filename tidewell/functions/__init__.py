"""Column expressions, and their twins for the driver."""
