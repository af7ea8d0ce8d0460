"""Sigloom: document signatures, search and evaluation on Spark DataFrames."""
