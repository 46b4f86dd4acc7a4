"""Operators of a training-data pipeline: deduplication, quality, licences, personal data, mixing, tokens."""
