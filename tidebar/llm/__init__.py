"""Operators for training-data pipelines: packing, near duplicates, scans, filters, formats."""
