"""Operators for preparing training data: duplicates, contamination, archives, tokens, scores."""
