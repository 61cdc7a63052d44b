"""Operators for training-data pipelines: mixing, sharding, packing, dedup, language, quality, search, URL rules.

Nothing outside this subpackage imports it.
"""
