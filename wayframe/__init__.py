"""Property-graph queries and corpus preparation on Spark DataFrames."""
