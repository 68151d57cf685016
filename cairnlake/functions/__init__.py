"""Column builders and text functions."""
