"""Plan, read and check large tensor checkpoints with Spark DataFrames."""
