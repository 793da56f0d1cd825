"""Retrieval and index-maintenance operators on DataFrames."""
