"""Operators over catalogue tables: each takes and returns DataFrames."""
