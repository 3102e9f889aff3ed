"""Standoff annotation and entity-linking analytics on Spark DataFrames."""
