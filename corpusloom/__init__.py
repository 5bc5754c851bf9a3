"""Corpus curation and label aggregation on Spark."""
