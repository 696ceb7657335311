"""Operators of a training-data pipeline: duplicates, search, packing, mixing, scans and filters over documents."""
