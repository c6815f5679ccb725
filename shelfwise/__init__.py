"""Data quality and commerce analytics on Spark DataFrames.

Every operator takes a DataFrame (or Column) and returns a DataFrame (or
Column) made of built-in Spark expressions.
"""
