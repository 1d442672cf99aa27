"""Exact byte-level BPE token ids through the tokenizers library, with pre-tokens cached.

Byte-level BPE merges inside pre-tokens only, so a text's ids are its pre-tokens' ids in a row. Texts of
common characters are cut into pre-tokens by array operations, looked up by 64-bit hash in a table of
bounded size, and each new pre-token is encoded by the library. A text with any other character, or
with an apostrophe that may begin a contraction, goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common as C

#: What a byte is in a text of common characters: white space, letter, digit, other. 4: the text goes to the library.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[32:127] = OTHER
CLASS[[9, 10, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[128:192] = CLASS[0xC3:0xCA] = LETTER  # U+00C0 to U+024F, but for what odd() finds
CONTRACTED = np.zeros(256, bool)
CONTRACTED[list(b"strvmld")] = True
#: The same rule for one string, contractions included, and the characters that it doesn't know.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
RARE = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]")
#: How the vocabulary writes a leading space.
LEAD = "Ġ"


def odd(raw: np.ndarray) -> np.ndarray:
    """Places of what the library must cut: rare characters, contractions, special tokens."""
    found = CLASS[raw] == ODD
    a, b = raw[:-1], raw[1:]
    # the signs U+00D7 and U+00F7; letters beyond U+024F; 's and the like; <|
    found[:-1] |= (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC9) & (b >= 0x90) | (a == 39) & CONTRACTED[b] | (a == 60) & (b == 124)
    return np.flatnonzero(found)


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: runs of letters, digits or others, each with one space before; of white space before
    them, the last is parted; other white space is a run."""
    kind = CLASS[raw]
    start = np.empty(len(raw), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    start |= first
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    start[last] = True
    start[last + 1] = raw[last] != 32
    return np.flatnonzero(start)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers; keeps at most ``most`` pre-tokens."""

    def __init__(self, path: str, most: int = 400_000, plain_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token[0] == LEAD]] = True
        self.most, self.size = most, 0
        slots = 1 << (2 * most - 1).bit_length()
        self.mask = np.uint64(slots - 1)
        self.hash = np.zeros(slots, np.uint64)
        self.entry = np.zeros(slots, np.int32)
        self.first = np.zeros(most, np.int64)
        self.count = np.zeros(most, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.seen: dict[str, int] = {}

    def n_ids(self, word: str) -> int:
        """Ids of one pre-token; at most ``most`` / 4 are remembered."""
        n = self.seen.get(word)
        if n is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
            if 4 * len(self.seen) < self.most:
                self.seen[word] = n
        return n

    def words(self, text: str) -> Iterator[str]:
        """Pre-tokens of one string of any characters, one by one."""
        if RARE.search(text) is None:
            return (m[0] for m in PRE_TOKEN.finditer(text))
        return (text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _library(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids), np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if it has none: two slots may hold it."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & self.mask).astype(np.int64)
        hit = self.hash[slot] == h
        out[hit] = self.entry[slot[hit]]
        rest = np.flatnonzero(~hit)
        slot = (h[rest] >> np.uint64(40) & self.mask).astype(np.int64)
        hit = self.hash[slot] == h[rest]
        out[rest[hit]] = self.entry[slot[hit]]
        return out

    def _keep(self, h: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Enter new pre-tokens where there is room and one of their slots is free."""
        n = min(len(h), self.most - self.size)
        if n <= 0:
            return
        left = np.arange(n)
        for slot in (h[:n] & self.mask, h[:n] >> np.uint64(40) & self.mask):
            slot = slot.astype(np.int64)[left]
            free = np.flatnonzero(self.hash[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.hash[slot[won]] = h[left[won]]
            self.entry[slot[won]] = self.size + left[won]
            left = np.delete(left, won)
        end = int(first[n - 1] + count[n - 1])
        if self.used + end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + end, np.uint32)])
        self.ids[self.used : self.used + end] = ids[:end]
        self.first[self.size : self.size + n] = first[:n] + self.used
        self.count[self.size : self.size + n] = count[:n]
        self.used += end
        self.size += n

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        # " word" pre-tokens are encoded as one text: each begins at the next id with a leading space
        plain = [k for k, w in enumerate(words) if w[0] == " " and len(w) > 1 and w[1].isalpha()]
        ids = self._library("".join([words[k] for k in plain]))
        starts = np.flatnonzero(self.leads[ids])
        parts: list = [None] * len(words)
        if len(starts) == len(plain):
            edge = [*starts.tolist(), len(ids)]
            for k, a, b in zip(plain, edge, edge[1:], strict=False):
                parts[k] = ids[a:b]
        for k, w in enumerate(words):
            if parts[k] is None:
                parts[k] = self._library(w)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts of common characters: where pre-tokens start, how many ids each has, and the ids."""
        starts = cuts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        h = C.Sums(raw).hashes(starts, ends)
        entry = self._find(h)
        lost = np.flatnonzero(entry < 0)
        count = self.count[entry].astype(np.int64)
        first = self.first[entry]
        store = self.ids[: self.used]
        if len(lost):
            fresh, at, of = np.unique(h[lost], return_index=True, return_inverse=True)
            at = lost[at]
            data = raw.tobytes()
            words = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            new, n = self._encode_new(words)
            begin = np.cumsum(n) - n
            count[lost], first[lost] = n[of], begin[of] + len(store)
            store = np.concatenate([store, new])
            self._keep(fresh, new, begin, n)
        place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return starts, count, store[place]

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null has none."""
        raw, offsets = C.utf8(texts, end="")
        n = len(texts)
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offsets, odd(raw), "right") - 1] = True
        if whole.any():
            own = texts.filter(pa.array(~whole))
            raw, offsets = C.utf8(own, end="")
        out: list = [None] * n
        for k in np.flatnonzero(whole):
            out[k] = self._library(texts[int(k)].as_py())
        if len(raw):
            starts, count, ids = self.pieces(raw, offsets)
            total = np.concatenate([[0], np.cumsum(count)])
            edge = total[np.searchsorted(starts, offsets)].tolist()
        else:
            ids, edge = np.zeros(0, np.uint32), [0] * len(offsets)
        for k, a, b in zip(np.flatnonzero(~whole).tolist(), edge, edge[1:], strict=False):
            out[k] = ids[a:b]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.large_string()))[0]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, plain_special: bool = False) -> Encoder:
    """One encoder for each Python worker and file."""
    key = (path, plain_special)
    if key not in _encoders:
        _encoders[key] = Encoder(path, plain_special=plain_special)
    return _encoders[key]
