"""Relational and iterative operators: DataFrames in, DataFrames out."""
