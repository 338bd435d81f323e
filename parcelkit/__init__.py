"""Plan-layer analytics on Spark DataFrames."""
