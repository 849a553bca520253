"""Scans that produce DataFrames of lines."""
