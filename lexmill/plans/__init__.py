"""plans of lexmill."""
