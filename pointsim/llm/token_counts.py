"""Token counts that follow edits.

A document is a segment tree over its pre-tokens: leaves of about ``LEAF`` pre-tokens hold their bytes, lengths
and token counts, inner nodes the sums of bytes, characters and tokens. Byte-level BPE merges inside
pre-tokens only, so an edit is local: from the last pre-token boundary that the edit cannot reach (the cutting
rule looks ahead by three characters at most) the text is cut anew until a new boundary meets an old one behind the edit;
from there on all is as it was. Only pre-tokens between the two are encoded again, and only the sums above them change.

Edits are (start, end, text) in characters of the document as the edits before have left it; places beyond the
end are its end, an end before the start is the start. Special tokens' strings are ordinary text.

Defined results: a null text is an empty one and has no tokens; null edits are none, and a null text in an
edit deletes; repeated rows are counted alike, each on its own.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_cache import Encoder, encoder, odd

LEAF = 64
#: Bytes of the characters that the cutting rule looks ahead, and more.
AHEAD = 16
BYTES, CHARS, TOKENS = range(3)


@dataclass(frozen=True)
class Rules:
    tokenizer: str


def _chars(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Characters between starts."""
    own = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.diff(own[np.append(starts, len(raw))])


def measured(made: Encoder, data: bytes) -> np.ndarray:
    """(pre-tokens, 3): bytes, characters and tokens."""
    return _rows([(len(w.encode()), len(w), made.n_ids(w)) for w in made.words(data.decode())])


def _rows(rows: list[tuple[int, int, int]]) -> np.ndarray:
    return np.array(rows, np.int64).reshape(-1, 3)


class Tree:
    """leaves[k]: bytes and (pre-tokens, 3); sums: a heap, sums[1] of all, sums[cap + k] of leaf k."""

    def __init__(self, data: bytes, rows: np.ndarray):
        self._build(data, rows)
        self.encoded = 0

    def _build(self, data: bytes, rows: np.ndarray) -> None:
        n = max(1, -(-len(rows) // LEAF))
        self.cap = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.cap, 3), np.int64)
        if len(rows):
            self.sums[self.cap : self.cap + n] = np.add.reduceat(rows, np.arange(0, len(rows), LEAF), axis=0)
        level = self.cap
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2
        edge = np.concatenate([[0], np.cumsum(self.sums[self.cap : self.cap + n, BYTES])]).tolist()
        self.data = [data[a:b] for a, b in zip(edge, edge[1:], strict=False)] + [b""] * (self.cap - n)
        self.rows = [rows[k * LEAF : (k + 1) * LEAF] for k in range(n)] + [rows[:0]] * (self.cap - n)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, TOKENS])

    @property
    def chars(self) -> int:
        return int(self.sums[1, CHARS])

    def text(self) -> bytes:
        return b"".join(self.data)

    def locate(self, char: int) -> tuple[int, int]:
        """Leaf and byte in it of a character; of the end, the last leaf that isn't empty and its length."""
        node = 1
        while node < self.cap:
            node *= 2
            left = int(self.sums[node, CHARS])
            if char >= left and self.sums[node + 1, CHARS]:
                char -= left
                node += 1
        leaf = node - self.cap
        edge = np.cumsum(self.rows[leaf][:, CHARS])
        k = int(np.searchsorted(edge, char, "right"))
        if k >= len(edge):
            return leaf, len(self.data[leaf])
        at = int(self.rows[leaf][:k, BYTES].sum())
        piece = self.data[leaf][at : at + int(self.rows[leaf][k, BYTES])].decode()
        return leaf, at + len(piece[: char - (int(edge[k - 1]) if k else 0)].encode())

    def edit(self, made: Encoder, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        (a, at_a), (b, at_b) = self.locate(start), self.locate(end)
        # left: the last boundary whose pre-token before ends well before the edit
        while True:
            keep, first, edge = 0, 0, 0
            for k, n in enumerate(self.rows[a][:, BYTES].tolist()):
                edge += n
                if edge + AHEAD > at_a:
                    break
                keep, first = k + 1, edge
            if keep or a == 0:
                break
            a -= 1
            at_a += len(self.data[a])
        # right: leaf b and as many more as it takes for a new boundary to meet an old one
        last, fresh = b, new.encode()
        while True:
            old = np.concatenate(self.rows[a : last + 1])[keep:] if last > a else self.rows[a][keep:]
            data = b"".join(self.data[a : last + 1])[first:]
            lo = at_a - first
            hi = sum(len(x) for x in self.data[a:b]) + at_b - first
            after, k = b"", last + 1
            while len(after) < AHEAD and k < len(self.data):
                after += self.data[k][: AHEAD + 4]
                k += 1
            cut = min(len(after), AHEAD)
            while cut < len(after) and after[cut] & 0xC0 == 0x80:
                cut += 1
            window = data[:lo] + fresh + data[hi:]
            shift = len(window) - len(data)
            edges = np.cumsum(old[:, BYTES]).tolist()
            place = {n: i + 1 for i, n in enumerate(edges) if n >= hi}
            if hi == 0:
                place[0] = 0
            # the start of what comes after is a boundary that can be met, as long as there is text to see behind it
            own: list[tuple[int, int, int]] = []
            at, met = 0, place.get(-shift) if shift == 0 and hi == 0 else None
            if met is None:
                for w in made.words((window + after[:cut]).decode()):
                    n = len(w.encode())
                    at += n
                    own.append((n, len(w), made.n_ids(w)))
                    if at > len(window) or (at == len(window) and not after):
                        break
                    met = place.get(at - shift)
                    if met is not None:
                        break
            if met is not None or not after:
                break
            last += 1
        if met is None:
            met = len(old)
        self.encoded += sum(c for _, c, _ in own)
        rows = np.concatenate([self.rows[a][:keep], _rows(own), old[met:]])
        whole = self.data[a][:first] + window
        if len(rows) > 4 * LEAF:
            every = np.concatenate([*self.rows[:a], rows, *self.rows[last + 1 :]])
            self._build(b"".join([*self.data[:a], whole, *self.data[last + 1 :]]), every)
            return
        self.data[a], self.rows[a] = whole, rows
        for k in range(a + 1, last + 1):
            self.data[k], self.rows[k] = b"", rows[:0]
        for k in range(a, last + 1):
            self.sums[self.cap + k] = self.rows[k].sum(axis=0)
        lo, hi = (self.cap + a) // 2, (self.cap + last) // 2
        while lo:
            for node in range(lo, hi + 1):
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            lo, hi = lo // 2, hi // 2

    def dump(self) -> bytes:
        """The tree without its text."""
        rows = np.concatenate(self.rows)
        return struct.pack("<I", len(rows)) + rows.astype("<u4").tobytes()


def load(data: bytes, tree: bytes) -> Tree:
    (n,) = struct.unpack_from("<I", tree)
    return Tree(data, np.frombuffer(tree, "<u4", 3 * n, 4).reshape(n, 3).astype(np.int64))


def trees(made: Encoder, texts: pa.Array) -> list[Tree]:
    """Trees of many texts; those of common characters are cut and looked up together."""
    raw, offsets = C.utf8(texts, end="")
    n = len(texts)
    whole = np.zeros(n, bool)
    whole[np.searchsorted(offsets, odd(raw), "right") - 1] = True
    out: list = [None] * n
    common = np.flatnonzero(~whole)
    own, edge = C.utf8(texts.filter(pa.array(~whole)), end="") if whole.any() else (raw, offsets)
    data = own.tobytes()
    if len(own):
        starts, count, _ = made.pieces(own, edge)
        rows = np.stack([np.diff(np.append(starts, len(own))), _chars(own, starts), count], 1)
        at = np.searchsorted(starts, edge)
    else:
        rows, at = np.zeros((0, 3), np.int64), np.zeros(len(edge), np.int64)
    for k, a, b, i, j in zip(common.tolist(), edge[:-1].tolist(), edge[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[k] = Tree(data[a:b], rows[i:j])
    for k in np.flatnonzero(whole).tolist():
        text = raw[offsets[k] : offsets[k + 1]].tobytes()
        out[k] = Tree(text, measured(made, text))
    return out


EDITS = "array<struct<start: bigint, end: bigint, text: string>>"


def _apply(made: Encoder, tree: Tree, edits: list | None) -> int:
    for e in edits or ():
        if e is not None:
            tree.edit(made, e["start"] or 0, e["end"] or 0, e["text"] or "")
    return len(edits or ())


def build(docs: DataFrame, rules: Rules) -> DataFrame:
    """Per row of docs: doc_id, text, n_tokens, tree."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("tree", pa.binary())])

    def run(batches):
        made = encoder(rules.tokenizer, plain_special=True)
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for i, j in C.pieces(text, 1_000_000):
                own = trees(made, text[i:j])
                yield C.record(schema, [ids[i:j], text[i:j], [t.tokens for t in own], [t.dump() for t in own]])

    return C.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, text string, n_tokens long, tree binary")


def update(built: DataFrame, edits: Column, rules: Rules) -> DataFrame:
    """built: rows of build() with what edits needs. Texts, counts and trees after the edits, and the characters encoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("tree", pa.binary()), ("n_encoded", pa.int64())])

    def run(batches):
        made = encoder(rules.tokenizer, plain_special=True)
        for batch in batches:
            for i, j in C.pieces(batch.column("text"), 1_000_000):
                out = []
                for text, tree, own in zip(*(batch.column(k)[i:j].to_pylist() for k in ("text", "tree", "__edits")), strict=True):
                    t = load((text or "").encode(), tree)
                    _apply(made, t, own)
                    out.append((t.text().decode(), t.tokens, t.dump(), t.encoded))
                yield C.record(schema, [batch.column("doc_id")[i:j], *(list(c) for c in zip(*out, strict=True))])

    return C.map_arrow(built.select("doc_id", "text", "tree", edits.cast(EDITS).alias("__edits")), run, "doc_id long, text string, n_tokens long, tree binary, n_encoded long")


def counts(docs: DataFrame, edits: Column, rules: Rules) -> DataFrame:
    """Per row of docs, before and after its edits: characters and tokens; and the characters encoded again."""
    names = ("n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_encoded")
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in names)])

    def run(batches):
        made = encoder(rules.tokenizer, plain_special=True)
        for batch in batches:
            ids, text, own = batch.column("doc_id"), batch.column("text"), batch.column("__edits")
            for i, j in C.pieces(text, 1_000_000):
                out = []
                for tree, e in zip(trees(made, text[i:j]), own[i:j].to_pylist(), strict=True):
                    before = tree.chars, tree.tokens
                    out.append((*before, _apply(made, tree, e), tree.chars, tree.tokens, tree.encoded))
                yield C.record(schema, [ids[i:j], *(list(c) for c in zip(*out, strict=True))])

    return C.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", edits.cast(EDITS).alias("__edits")), run, "doc_id long, " + ", ".join(f"{k} long" for k in names))


def revision(text: str = "text") -> Column:
    """A small revision of each text: a passage goes, a sentence comes in, a few words are replaced."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    part = lambda k: F.floor(n * k / F.lit(4)).cast("bigint")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("text"))
    return F.when(F.col(text).isNotNull(), F.array(edit(part(1), part(1) + 40, ""), edit(part(2), part(2), " A sentence that wasn't here, of 12 words or so."), edit(part(3), part(3) + 12, "re-written")))
