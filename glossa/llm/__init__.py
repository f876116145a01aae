"""Operators of a training-data pipeline: filtering, deduplication, formatting and tokenising of text corpora.

Nothing else in the library imports this subpackage.
"""
