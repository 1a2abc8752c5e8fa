"""Extraction analytics on Spark DataFrames."""
