"""Operators for training data: distinct counts, frequent items, set joins, tokens, text."""
