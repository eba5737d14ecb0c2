"""Column functions: text, hashing, vectors."""
