"""Column functions: text expansion, paths, vectors."""
