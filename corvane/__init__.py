"""Hybrid retrieval analytics on Spark."""
