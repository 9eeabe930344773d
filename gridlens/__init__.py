"""Explore parquet data one table at a time, on Spark."""
