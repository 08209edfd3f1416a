"""Compact graph storage, graph analytics and corpus preparation on Spark DataFrames."""
