"""Neighbour graphs, force layouts and their evaluation on Spark DataFrames."""
