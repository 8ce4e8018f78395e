"""Knowledge analytics on Spark DataFrames."""
