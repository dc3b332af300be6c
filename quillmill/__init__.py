"""Corpus curation, matching and audit on Spark DataFrames."""

__version__ = "0.1.0"
