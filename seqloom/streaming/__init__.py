"""Continuous mining of arriving sequences."""
