"""Operators over cell tables; each takes and returns DataFrames."""
