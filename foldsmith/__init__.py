"""Foldsmith: curation, splitting and benchmarking of measurement tables on Spark."""
