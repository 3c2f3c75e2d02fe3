"""Structured Streaming over facts."""
