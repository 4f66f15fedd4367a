"""Cartulary: a code-intelligence and corpus analytics engine on Spark DataFrames."""
