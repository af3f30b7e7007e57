"""Sequence analytics as Spark DataFrame functions."""
