"""Readers and writers for samples, raw datasets and the results log."""
