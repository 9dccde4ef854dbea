"""Operators for training-data pipelines: archives, tokens, deduplication, filters."""
