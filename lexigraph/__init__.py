"""Lexigraph: text search, similarity graphs and training-data operators on Spark."""
