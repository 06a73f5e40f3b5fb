"""Event-related time-frequency analytics on Spark DataFrames."""
