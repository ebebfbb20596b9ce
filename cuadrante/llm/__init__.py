"""Operators for building training corpora: cleaning, deduplication, scoring, mixing and packing.

Nothing outside this package imports it. ``registry`` holds the queries that the entry module adds.
"""
