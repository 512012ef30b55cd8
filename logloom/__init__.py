"""Log analytics on Spark DataFrames."""
