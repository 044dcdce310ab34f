"""Operators for large training-data pipelines: filters, dedup, packing, search, codecs and archives."""
