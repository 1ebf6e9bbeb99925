"""Column functions: vectors, time, text."""
