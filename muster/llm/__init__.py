"""Operators of a training-data pipeline: search, extraction, filtering, mixing, packing."""
