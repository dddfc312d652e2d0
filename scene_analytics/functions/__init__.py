"""Column functions: vectors, colours, names."""
