"""Similarity search over collections of planar point sets, as DataFrame operators."""
