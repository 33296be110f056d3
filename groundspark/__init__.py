"""Retrieval over parsed, character-addressed documents as declarative Spark plans."""
