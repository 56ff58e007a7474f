"""Column functions. Every function takes and returns Spark columns; none runs Python per row."""
