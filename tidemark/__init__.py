"""Behaviour-log analytics on Spark DataFrames."""
