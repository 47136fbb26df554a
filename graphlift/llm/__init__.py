"""Operators of a training-data pipeline: filters, scans, counts, joins, search and packing.

Nothing else in the library imports this package. Its queries and their SQL are in ``queries``.
"""
