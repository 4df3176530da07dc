"""A typed, closed query language on Spark DataFrames."""
