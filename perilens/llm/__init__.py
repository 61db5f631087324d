"""Operators of a training-data pipeline: counting, deduplication, extraction, scoring and scanning."""
