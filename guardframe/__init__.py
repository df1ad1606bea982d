"""guardframe: content-safety analytics on Spark DataFrames."""
