"""Operators of a training-data pipeline: deduplication, cleaning, tokens, chat rendering."""
