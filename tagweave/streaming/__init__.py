"""Structured Streaming and batch scoring."""
