"""Training-data operators: search, tokenising, extraction, scanning, deduplication, packing and classifiers.

Nothing outside this subpackage imports it.
"""
