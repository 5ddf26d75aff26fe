"""A small analytics engine expressed as Spark DataFrames."""
