"""Parameters of grids and fingerprints, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridParams:
    """Square cells of side ``delta`` over coordinates from 0 to ``cmax``, numbered row by row.

    The row length is ``cmax`` div ``delta``, so x = cmax shares a number with the next row's first cell; with
    ``alias_safe`` cells are numbered over one more column and never share.
    """

    cmax: int = 10_000
    delta: int = 100
    alias_safe: bool = False

    def __post_init__(self):
        if self.cmax <= 0 or self.delta <= 0 or self.delta > self.cmax:
            raise ValueError("0 < delta <= cmax is required")

    @property
    def stride(self) -> int:
        return self.cmax // self.delta + (2 if self.alias_safe else 0)


@dataclass(frozen=True)
class FingerprintParams:
    """Lattice step, and the target zone right of an anchor: its distance, width, height and how many of its points count.

    ``clip_bottom``: anchors nearer to the bottom than half the zone's height have a clipped zone; otherwise they have none.
    """

    delta: int = 1
    delay_x: int = 0
    delta_x: int = 500
    delta_y: int = 500
    limit: int = 10
    clip_bottom: bool = False

    def __post_init__(self):
        if min(self.delta, self.delta_x, self.delta_y, self.limit) <= 0 or self.delay_x < 0:
            raise ValueError("delta, delta_x, delta_y and limit must be positive, delay_x not negative")


def check_k(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k
