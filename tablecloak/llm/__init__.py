"""Operators for training data: quality, filters, near duplicates, tokens, search, extraction."""
