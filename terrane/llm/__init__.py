"""Operators of a training-data pipeline: deduplication, scoring, filtering, search and tokenising of document tables.

Nothing else in the library imports this subpackage.
"""
