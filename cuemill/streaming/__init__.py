"""Structured Streaming forms of the segment and queue jobs."""
