"""Operators of a large-scale training-data pipeline: similarity, grouping, ranking and text."""
