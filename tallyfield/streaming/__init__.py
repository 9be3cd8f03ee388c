"""Structured Streaming forms of a few operators."""
