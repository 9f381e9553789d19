"""Log, text and event analytics on Spark DataFrames."""
