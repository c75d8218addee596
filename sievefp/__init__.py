"""Similarity search over large collections of fixed-width binary fingerprints, on Spark."""

__version__ = "0.1.0"
