"""Operators of a training-data pipeline: deduplication, filters, mixing, search and scans.

Nothing else in the library imports this subpackage.
"""
