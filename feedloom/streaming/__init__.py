"""Incremental refresh of growing feed folders with Structured Streaming."""
