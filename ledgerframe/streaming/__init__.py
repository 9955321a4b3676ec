"""Replication of a change log by Structured Streaming."""
