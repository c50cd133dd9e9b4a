"""Operators over property graphs, documents and vectors; each takes and returns DataFrames."""
