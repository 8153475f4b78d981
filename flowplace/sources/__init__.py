"""Readers of the data formats."""
