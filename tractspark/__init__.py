"""Tract measurement analytics on Spark: DataFrames in, DataFrames out."""
