"""Operators of a training-data pipeline, written for Spark.

One module per operator; ``queries`` registers the digests the driver checks.
Nothing outside this subpackage imports it.
"""
