"""Profiling operators over DataFrames."""
