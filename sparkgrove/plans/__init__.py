"""Query planning."""
