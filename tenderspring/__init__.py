"""Procurement-signal analytics on Spark DataFrames."""
