"""Gridded climate analytics expressed with Spark DataFrames."""
