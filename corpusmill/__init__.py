"""Corpus preparation and experiment analytics on Spark."""
