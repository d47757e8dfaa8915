"""Set-based document analytics on Spark DataFrames."""
