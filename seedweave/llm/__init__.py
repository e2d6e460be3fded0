"""Operators of a training-data pipeline: deduplication, sharding, tokens, extraction, filters, packing."""
