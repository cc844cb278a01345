"""Operators on event DataFrames, grouped by what they do."""
