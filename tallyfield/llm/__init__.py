"""Operators for training-data pipelines over a table of documents."""
