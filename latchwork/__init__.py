"""latchwork: relationship-authorization analytics on Spark DataFrames."""
