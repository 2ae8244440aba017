"""trackloom: object-tracking analytics on Spark DataFrames."""
