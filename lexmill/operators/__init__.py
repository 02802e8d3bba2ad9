"""operators of lexmill."""
