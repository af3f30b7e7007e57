"""Operators for training-data pipelines over the text tables."""
