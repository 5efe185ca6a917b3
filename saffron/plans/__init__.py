"""Search queries and how they become DataFrames."""
