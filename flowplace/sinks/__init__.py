"""Formatters and writers of the data formats."""
