"""Fathomline: knowledge retrieval and analytics on Spark DataFrames."""
