"""Structured Streaming forms of the watchers. Every one has a batch twin in `operators`."""
