"""functions of lexmill."""
