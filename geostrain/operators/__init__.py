"""Operators over station tables, series, pixel stacks, pairs and rasters."""
