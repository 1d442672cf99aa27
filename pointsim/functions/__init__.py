"""Scalar functions: grid cells, point distances, set distances."""

from .distance import angular, floor_l2, hamming, jaccard, l2, l2_squared
from .grid import cell, lattice

__all__ = ["angular", "cell", "floor_l2", "hamming", "jaccard", "l2", "l2_squared", "lattice"]
