"""Readers and writers of subtitle, recogniser, log and metadata formats."""
