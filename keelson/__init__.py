"""Composite indicators and training-data operators on Spark DataFrames."""
