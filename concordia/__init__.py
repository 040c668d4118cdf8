"""A documentation-parity engine on Spark DataFrames."""
