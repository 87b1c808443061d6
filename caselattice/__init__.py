"""Constraint-evaluation analytics over Spark DataFrames."""
