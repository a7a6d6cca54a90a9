"""Document search and knowledge analytics on Spark DataFrames."""
