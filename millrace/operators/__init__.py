"""Operators of the exchange: DataFrames in, lazy DataFrames out."""
