"""Column functions and row functions."""
