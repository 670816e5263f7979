"""Spark-first analytics for bar time series."""
