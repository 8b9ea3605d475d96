"""lodestream: analytics operators for Spark DataFrames."""
