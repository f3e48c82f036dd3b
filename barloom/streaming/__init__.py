"""Streaming forms of the daily pipeline."""
