"""Spark-first analytics for page retrieval corpora and their evaluation."""
