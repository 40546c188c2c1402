"""Column functions: text, vectors, routing, verification."""
