"""Lectern: spoken-scripture analytics on Spark DataFrames."""
