"""Structured Streaming counterparts of the corpus statistics."""
