"""Operators of a training-data pipeline: deduplication, extraction, scoring, packing, sharding."""
