"""What the operators share: Python on executors, Arrow buffers as numpy arrays, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..arrow import give_back, map_arrow, ship  # noqa: F401  (for the operators)
from ..operators.ordered import summed_before  # noqa: F401  (for the operators)
from ..storage import Scratch, materialize, shared_dir, shared_path  # noqa: F401  (for the operators)

# ---------------------------------------------------------------- numpy views
def utf8(column: pa.Array, end: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by ``end``, and offsets (n + 1). Nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if end:
        joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))
    else:
        joined = column
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = joined.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64) + 1)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where it can be."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


#: A random odd 64-bit number for each byte value, from a fixed seed.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD1342543DE82EF95)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) * 5 // 4
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[name] = have
    return have[:n]


class Sums:
    """Prefix sums that give the 64-bit hash of any byte range."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        part = BYTE_CODES[raw]
        part *= _power("up", STEP, n)
        np.cumsum(part, out=self.total[1:])
        self.back = _power("down", STEP_BACK, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.total[ends] - self.total[starts]
        h *= self.back[starts]
        return mix(h)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the array ends with False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


#: Bytes of words that white space parts: all but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def windows(owner: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each k consecutive words of one owner: the index of the first, and their hash."""
    n = len(owner) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += hashes[i : i + n]
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return at, mix(h[at])


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- hashes in SQL
def hash60(*parts: Column) -> Column:
    """A 60-bit hash that SQL engines with md5 can repeat: the first 15 hex digits of md5."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")
