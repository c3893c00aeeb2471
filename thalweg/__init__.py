"""Drainage-network analytics and relational helpers on Spark DataFrames."""
