"""Operators of a large-scale training-data pipeline, each re-expressed as Spark jobs."""
