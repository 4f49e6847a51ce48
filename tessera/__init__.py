"""Tessera: governance analytics and text-data operators on Spark DataFrames."""
