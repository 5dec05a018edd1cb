"""Corpus operators: filtering, deduplication, scoring and mixing of training text."""
