"""Operators of the graph engine: DataFrames in, DataFrames out."""
