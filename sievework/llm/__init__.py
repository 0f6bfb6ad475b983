"""Operators of large training-data pipelines; their queries are in ``queries``."""
