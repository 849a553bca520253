"""Operators of a training-data pipeline: scoring, filtering, deduplication, sharding, tokens, chat."""
