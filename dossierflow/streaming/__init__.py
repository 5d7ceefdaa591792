"""Arriving documents and live progress as Structured Streaming jobs."""
