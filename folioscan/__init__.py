"""Document-corpus audit operators for Spark: every operator maps DataFrames to DataFrames."""
