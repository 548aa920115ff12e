"""Column statistics and string functions."""
