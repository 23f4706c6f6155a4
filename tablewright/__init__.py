"""Table reconciliation on Spark DataFrames."""
