"""Operators for preparing training text: sharding, deduplication, scans, mixing, packing and scoring."""
