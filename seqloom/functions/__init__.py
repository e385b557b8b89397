"""Column and small DataFrame functions."""
