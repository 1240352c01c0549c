"""Relative-value analytics on Spark DataFrames."""
