"""Column functions and helpers for long series."""
