"""Postings that grow with a stream of points. An addition of this library."""

from .append import append_postings, read_postings

__all__ = ["append_postings", "read_postings"]
