"""Operators of a training-data pipeline: tokens, classifiers, near duplicates, formatting and packing."""
