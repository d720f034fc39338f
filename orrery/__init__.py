"""Orrery: city-scale temporal knowledge-graph analytics on Spark DataFrames."""
