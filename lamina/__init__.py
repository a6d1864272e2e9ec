"""A multiversion columnar analytics engine on Spark DataFrames."""
