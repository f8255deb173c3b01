"""Passage analytics on Spark DataFrames."""
