"""Operators on whole tables: each takes DataFrames and gives a DataFrame, song by song."""
