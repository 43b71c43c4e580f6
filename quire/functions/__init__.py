"""Column functions, and the small per-document parsers."""
