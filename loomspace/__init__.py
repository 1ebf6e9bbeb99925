"""Multi-space retrieval and memory analytics on Spark DataFrames."""
