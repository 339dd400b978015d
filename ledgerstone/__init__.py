"""Spark-first analytics for material catalogues, take-offs and document extraction."""
