"""Dataset-audit and evaluation analytics on Spark DataFrames."""
