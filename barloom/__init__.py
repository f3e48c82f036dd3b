"""Barloom: a PySpark-native engine for daily price bars and point-in-time event studies."""
