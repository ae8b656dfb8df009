"""Call-graph and wrapper analytics on Spark DataFrames."""
