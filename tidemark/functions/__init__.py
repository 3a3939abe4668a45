"""Column functions for text, formats and names."""
