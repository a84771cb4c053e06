"""Ordered, schema-checked curriculum analytics on Spark DataFrames."""
