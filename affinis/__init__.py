"""Affinis: document similarity, near-duplicate detection and copied-passage evidence on Spark DataFrames."""

__version__ = "0.1.0"
