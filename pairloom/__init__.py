"""Record matching and pair analytics on Spark DataFrames."""
