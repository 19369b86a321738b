"""Tidemark: time-series exploration on Spark DataFrames."""
