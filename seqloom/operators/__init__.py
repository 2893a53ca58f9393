"""Operators over sequences: dictionaries, data sets and the ways to mine them."""
