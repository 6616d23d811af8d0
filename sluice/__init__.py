"""Spark-first corpus preparation and model-internals analytics."""
