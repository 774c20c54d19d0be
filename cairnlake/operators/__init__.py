"""Operators: every public one maps DataFrames to a DataFrame."""
