"""Structured Streaming counterparts of the trial and metric operators."""
