"""Operators of a training-data pipeline: text in, Spark jobs, one decision or number per document."""
