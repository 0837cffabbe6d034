"""Change-impact analytics over versioned dependency data, on Spark DataFrames."""
