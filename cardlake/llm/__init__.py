"""Operators of a training-data pipeline, from deduplication to packed token ids."""
