"""Document search and corpus processing on Spark DataFrames."""
