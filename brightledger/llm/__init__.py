"""Operators for training corpora: filtering, deduplication, mixing, tokenising, scoring and search."""
