"""Operators for preparing training data at scale: scanning, deduplication, scoring, mixing, search."""
