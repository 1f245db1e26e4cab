"""lodestream: time-series analytics and data preparation on Spark DataFrames."""
