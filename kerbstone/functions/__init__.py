"""Column functions: geometry, text, arrays and time."""
