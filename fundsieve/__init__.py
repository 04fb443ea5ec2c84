"""A catalogue and screening engine on Spark DataFrames."""
