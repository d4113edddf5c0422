"""Operators: DataFrames in, DataFrames out; nothing is collected."""
