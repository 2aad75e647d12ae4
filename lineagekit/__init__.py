"""Traceability analytics on Spark DataFrames."""
