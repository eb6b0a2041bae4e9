"""Structured Streaming counterparts of the incremental load."""
