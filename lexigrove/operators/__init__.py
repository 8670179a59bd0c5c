"""Operators of the text index; each takes and returns DataFrames."""
