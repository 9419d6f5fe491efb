"""Batch analytics for delimited device readings, expressed in Spark DataFrames."""
