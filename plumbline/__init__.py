"""A data profiler and recipe engine on Spark DataFrames."""
