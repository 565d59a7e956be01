"""Set-at-a-time content-risk analytics on Spark DataFrames."""
