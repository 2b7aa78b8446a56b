"""Relational and raster operators: DataFrames in, DataFrames out, columns as parameters."""
