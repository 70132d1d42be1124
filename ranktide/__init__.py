"""Rank-based model validation on Spark."""
