"""Column functions, fixed values and entity extraction."""
