"""Operators for training-data pipelines, and the queries that apply them."""
