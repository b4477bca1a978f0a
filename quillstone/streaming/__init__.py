"""Replication on Structured Streaming."""
