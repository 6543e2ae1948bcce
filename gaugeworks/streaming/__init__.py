"""Structured Streaming twins of the batch monitors."""
