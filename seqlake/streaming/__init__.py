"""Summaries over a stream of record files."""
