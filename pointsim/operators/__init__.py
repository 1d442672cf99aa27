"""Batch operators over long tables; every one takes and returns DataFrames."""
