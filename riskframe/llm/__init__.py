"""Operators for training-data pipelines: cleaning, ranking, deduplication, encoding, archives."""
