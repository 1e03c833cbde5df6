"""Trial-evaluation analytics on Spark: DataFrames in, DataFrames out."""
