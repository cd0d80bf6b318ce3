"""Spark jobs over large corpora of time-stamped transcripts."""
