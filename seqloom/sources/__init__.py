"""Readers, writers and the conversions of raw tables into sequences."""
