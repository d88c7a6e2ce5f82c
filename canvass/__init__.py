"""Survey-operations analytics on Spark DataFrames."""
