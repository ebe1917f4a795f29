"""Auditing prose at corpus scale on Spark DataFrames."""
