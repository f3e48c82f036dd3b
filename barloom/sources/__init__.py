"""Readers and canonical tables."""
