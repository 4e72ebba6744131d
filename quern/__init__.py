"""Quern: a query engine for several data models, built on Spark DataFrames."""
