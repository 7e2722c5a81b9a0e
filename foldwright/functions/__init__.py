"""Column expressions, fixed values and array/matrix helpers."""
