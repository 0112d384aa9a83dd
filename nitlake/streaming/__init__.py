"""Incremental forms of the sequence operators on Structured Streaming."""
