"""Retention operators: DataFrames in, DataFrame out."""
