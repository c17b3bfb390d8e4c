"""Structured Streaming twins of the batch capture operators."""
