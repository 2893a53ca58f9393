"""Operators for training-data pipelines: deduplication, sharding, media, toxicity, HTML, tokens and mixing.

Nothing else in the library imports this subpackage.
"""
