"""Operators on bar tables. Each takes and returns DataFrames, partitioned by the series key."""
