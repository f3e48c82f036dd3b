"""Operators for preparing training text: mixing, deduplication, extraction, scoring and sharding."""
