"""Structured Streaming forms of the state operators; each has a batch twin in ``operators``."""
