"""Operators for preparing training data: deduplication, scoring, encoding and formatting of document tables."""
