"""Column functions over text, arrays and records."""
