"""streaming of lexmill."""
