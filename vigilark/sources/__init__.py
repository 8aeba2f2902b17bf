"""Readers and writers of the pipe-delimited files, and logical tables over Parquet."""
