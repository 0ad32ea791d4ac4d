"""Operators of a training-data pipeline: filters, dedup, extraction, archives, mixing, packing."""
