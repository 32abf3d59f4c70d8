"""Operators for large text collections: scoring, deduplication, filtering, formatting, tokenising."""
