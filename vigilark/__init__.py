"""Vigilark: term-embedding and signal analytics expressed as Spark DataFrames."""
