"""A recipe-catalogue analytics engine on Spark DataFrames."""
