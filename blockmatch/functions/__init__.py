"""Column functions and byte functions."""
