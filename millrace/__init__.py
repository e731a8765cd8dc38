"""A relational, text-aggregation and vertex-program engine on Spark DataFrames."""
