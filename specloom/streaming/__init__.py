"""Structured Streaming: the batch charts and scores on unbounded input."""
