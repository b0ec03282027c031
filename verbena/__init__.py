"""Corpus preparation, count-based language models and experiment analytics on Spark."""
