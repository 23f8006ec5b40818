"""Object analytics on Spark DataFrames."""
