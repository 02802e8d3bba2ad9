"""sources of lexmill."""
