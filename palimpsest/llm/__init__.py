"""Operators for training-data pipelines: filtering, deduplication, mixing, scoring and counting."""
