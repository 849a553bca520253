"""Operators over DataFrames of lines and entries."""
