"""Operators of a training-data pipeline: sharding, mixing, tokenizing, near-duplicates, filters, archives, formats."""
