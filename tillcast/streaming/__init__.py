"""Structured Streaming versions of the incremental writes."""
