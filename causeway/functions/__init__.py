"""Column builders and lexicons."""
