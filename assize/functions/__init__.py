"""Column functions: scores, statistics, hashing, text and vectors."""
