"""Exports: single CSV, parquet and JSON files, workbooks, and the jobs that write them."""
