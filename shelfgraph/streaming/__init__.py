"""Structured Streaming forms of the upsert operators."""
