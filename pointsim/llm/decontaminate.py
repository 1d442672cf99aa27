"""Benchmark decontamination with suffix arrays of the training text.

Documents are taken in shards of about ``shard_bytes`` of text. A shard's suffix array orders the suffixes that start at
each of its words, to their full length; ``arrays`` writes it, with the shard's words, to the shared folder, where any number of
benchmarks can be searched. Every test suffix is binary-searched in every shard to the length of a window; the range found gives
the places of all occurrences. The longest verbatim match from a place is the longer of the common prefixes with its
two neighbours among the test suffixes, which have a suffix array as well.

The benchmark is a query set against all rows, in blocks of at most ``block_words`` words (a longer item is cut
into parts that overlap by a window less a word). Blocks are broadcast, and a worker holds one at a time, whatever their number.

Words are what is left of lower-cased text (A-Z only) between ASCII characters that are neither digits nor letters.
A window is ``window`` consecutive words of an item, or a whole shorter item. 64-bit hashes stand for words.

Defined results: null and blank texts have no words and are clean; blank items match nothing; a null item_id is listed as an
empty string; equal items count once, equal rows as rows of their own; an empty table of documents gives no rows, an empty benchmark
no hits. A text longer than a shard is a shard of its own, whole. Of equally long matches of a document the first counts.
Extra columns of either table are never read, and ``filtered`` passes them on.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of words: digits, letters, and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


@dataclass(frozen=True)
class Rules:
    window: int = 13
    min_percent: int = 5  # contaminated: 100 * n_hit >= min_percent * n_words
    shard_bytes: int = 2_000_000
    block_words: int = 500_000


class Words:
    """Word hashes of texts, with their owners."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = C.LOWER[raw]
        starts, ends = C.spans(WORD[low])
        self.hashes = C.Sums(low).hashes(starts, ends)
        self.owner = np.searchsorted(offsets, starts, "right") - 1
        self.n = np.bincount(self.owner, minlength=len(offsets) - 1)


# ---------------------------------------------------------------- suffix arrays
def laid_out(numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Word numbers of texts of n words each, with a 0 after each text."""
    out = np.zeros(int((n + 1).sum()), np.uint32)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(n)), n)] = numbers
    return out


def words_left(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its text."""
    ends = np.flatnonzero(text == 0)
    return ends[np.searchsorted(ends, at)] - at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all words, ordered by the words from there to the text's end; equal suffixes by place.

    Prefix doubling: groups of suffixes that agree in k words are sorted by their next k, until none is left that goes on.
    """
    at = np.flatnonzero(text)
    order = at[np.argsort(text[at], kind="stable")]
    if not len(order):
        return order
    left = np.zeros(len(text), np.int64)
    left[at] = words_left(text, at)
    rank = np.zeros(len(text), np.int64)  # 1 + the first slot of the group

    def grouped(slots: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First member of each group of equal keys, and the groups' sizes; their members' ranks are set."""
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([head, [len(key)]]))
        rank[order[slots]] = np.repeat(slots[head] + 1, size)
        return head, size

    slots = np.arange(len(order))
    _, size = grouped(slots, text[order])
    slots = slots[np.repeat(size > 1, size)]
    k = 1
    while len(slots):
        own = order[slots]
        on = left[own] > k
        key = rank[own] * (len(text) + 2)
        key[on] += rank[own[on] + k]
        by = np.argsort(key, kind="stable")
        order[slots], key, on = own[by], key[by], on[by]
        head, size = grouped(slots, key)
        slots = slots[np.repeat((size > 1) & on[head], size)]
        k *= 2
    return order


class Shard:
    """Training texts with the suffix array over all their words."""

    def __init__(self, text: np.ndarray, vocabulary: np.ndarray, order: np.ndarray, n: np.ndarray):
        self.text, self.vocabulary, self.order, self.n = text, vocabulary, order, n
        self.first = np.cumsum(n + 1) - (n + 1)
        self.bits = int(len(vocabulary)).bit_length() or 1
        self.packed = 63 // self.bits  # words that one number holds
        self.keys = self.pack(order, 0)

    @classmethod
    def of(cls, texts: pa.Array) -> Shard:
        words = Words(*C.utf8(texts))
        vocabulary, numbers = np.unique(words.hashes, return_inverse=True)
        text = laid_out(numbers + 1, words.n)
        return cls(text, vocabulary, suffix_array(text), words.n)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def pack(self, at: np.ndarray, skip: int) -> np.ndarray:
        """The next words after ``skip`` of the suffixes at ``at``, as numbers that sort as they do. All have ``skip`` words."""
        out, on = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        last = len(self.text) - 1
        for d in range(self.packed):
            word = self.text[np.minimum(at + (skip + d), last)]
            on &= word > 0
            out = out << self.bits | np.where(on, word, 0)
        return out

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, skip: int, key: np.ndarray, after: bool) -> np.ndarray:
        """Within each range of slots, the first whose next words aren't below the key, or are above it."""
        lo, hi = lo.copy(), hi.copy()
        while len(still := np.flatnonzero(lo < hi)):
            mid = (lo[still] + hi[still]) // 2
            probe = self.pack(self.order[mid], skip)
            below = probe <= key[still] if after else probe < key[still]
            lo[still[below]] = mid[below] + 1
            hi[still[~below]] = mid[~below]
        return lo

    def ranges(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: a row of numbers for each pattern, of which ``length`` count. The slots of the suffixes that start with it: from, to."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(self.order), np.int64)
        live = np.arange(len(words))
        for skip in range(0, words.shape[1], self.packed):
            live = live[(length[live] > skip) & (hi[live] > lo[live])]
            low, high = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            for d in range(skip, skip + self.packed):
                inside = d < length[live]
                own = words[live, min(d, words.shape[1] - 1)]
                low = low << self.bits | np.where(inside, own, 0)
                high = high << self.bits | np.where(inside, own, (1 << self.bits) - 1)
            if skip:
                was, end = lo[live], hi[live]
                lo[live], hi[live] = self._bisect(was, end, skip, low, False), self._bisect(was, end, skip, high, True)
            else:
                lo[live], hi[live] = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        return lo, np.maximum(hi, lo)


def common_words(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """How many words agree from places at in a and bt in b on; both end with a 0."""
    n = np.zeros(len(at), np.int64)
    on = np.arange(len(at))
    while len(on):
        x = a[at[on] + n[on]]
        on = on[(x > 0) & (x == b[bt[on] + n[on]])]
        n[on] += 1
    return n


# ---------------------------------------------------------------- benchmark
class Block:
    """Test texts: their words, the suffix array over them, and their distinct windows with the items that have them."""

    def __init__(self, ids: list[str], parts: list[np.ndarray], starts: list[int], window: int):
        """parts: word hashes of each item or part of one, which starts at the word ``starts`` of its item."""
        found: dict[str, int] = {}
        self.item = np.array([found.setdefault(x, len(found)) for x in ids], np.int64)
        self.ids, self.window = list(found), window
        n = np.array([len(x) for x in parts], np.int64)
        self.vocabulary, numbers = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)
        self.text = laid_out(numbers + 1, n)
        self.first = np.cumsum(n + 1) - (n + 1)
        self.start = np.asarray(starts, np.int64)
        self.order = suffix_array(self.text)
        part = self.part(self.order)
        size = np.minimum(n, window)[part]
        full = np.flatnonzero(words_left(self.text, self.order) >= size) if len(part) else np.zeros(0, np.int64)
        at, size, part = self.order[full], size[full], part[full]
        full = np.flatnonzero((size == window) | (at == self.first[part]))
        at, size, part = at[full], size[full], part[full]
        fresh = np.ones(len(at), bool)
        if len(at):  # equal windows are neighbours
            fresh[1:] = size[1:] != size[:-1]
            for d in range(window):
                own = np.flatnonzero(~fresh & (size > d))
                fresh[own] = self.text[at[own] + d] != self.text[at[own - 1] + d]
        group = np.cumsum(fresh) - 1
        self.at, self.size = at[fresh], size[fresh]
        pairs = np.unique(group * max(len(found), 1) + self.item[part])
        self.items = pairs % max(len(found), 1)
        self.items_from = np.searchsorted(pairs // max(len(found), 1), np.arange(len(self.at) + 1))
        self.places, self.places_from = at, np.concatenate([np.flatnonzero(fresh), [len(at)]])

    def part(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def search(self, shard: Shard, step: int = 100_000):
        """(numbers of windows, places in the shard) of all occurrences, a piece at a time."""
        if not len(self.at) or not len(shard.order):
            return
        k = np.minimum(np.searchsorted(shard.vocabulary, self.vocabulary), len(shard.vocabulary) - 1)
        number = np.concatenate([[0], np.where(shard.vocabulary[k] == self.vocabulary, k + 1, 0)])
        text = number[self.text]
        missing = np.concatenate([[0], np.cumsum(text == 0)])
        live = np.flatnonzero(missing[self.at + self.size] == missing[self.at])
        last = len(text) - 1
        for a in range(0, len(live), step):
            own = live[a : a + step]
            words = np.stack([text[np.minimum(self.at[own] + d, last)] for d in range(self.window)], 1)
            lo, hi = shard.ranges(words, self.size[own])
            n = hi - lo
            if n.any():
                slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                yield np.repeat(own, n), shard.order[slot]

    def longest(self, shard: Shard, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places in the shard: how many words the longest verbatim match from there has, and the place of one in the test texts."""
        k = np.searchsorted(self.vocabulary, shard.vocabulary)
        same = self.vocabulary[np.minimum(k, len(self.vocabulary) - 1)] == shard.vocabulary
        # test words have even numbers, others the odd ones between: both texts sort alike
        own = np.concatenate([[0], np.where(same, 2 * k + 2, 2 * k + 1)])[shard.text]
        test = 2 * self.text.astype(np.int64)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        while len(still := np.flatnonzero(lo < hi)):
            mid = (lo[still] + hi[still]) // 2
            q, p = self.order[mid], at[still]
            n = common_words(own, p, test, q)
            below = test[q + n] < own[p + n]
            lo[still[below]] = mid[below] + 1
            hi[still[~below]] = mid[~below]
        near = [self.order[np.clip(lo + d, 0, len(self.order) - 1)] for d in (-1, 0)]
        n = [common_words(own, at, test, q) for q in near]
        return np.maximum(*n), np.where(n[0] >= n[1], *near)

    def matches(self, shard: Shard, most: int = 1_000_000):
        """(owner, item, word, word of the item, words): longest verbatim matches of a window at least, a piece at a time."""
        k = np.minimum(np.searchsorted(self.vocabulary, shard.vocabulary), max(len(self.vocabulary) - 1, 0))
        own = np.concatenate([[0], np.where(self.vocabulary[k] == shard.vocabulary, k + 1, -1)])[shard.text] if len(self.vocabulary) else None
        test = self.text.astype(np.int64)
        for which, at in self.search(shard):
            total = np.cumsum(self.places_from[which + 1] - self.places_from[which])
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
                w, p = which[a:b], at[a:b]
                n = self.places_from[w + 1] - self.places_from[w]
                q = self.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.places_from[w], n)]
                p = np.repeat(p, n)
                # those that don't go on to the left
                first = (p == 0) | (q == 0) | (own[p - 1] != test[q - 1]) | (own[p - 1] == 0)
                p, q = p[first], q[first]
                size = common_words(own, p, test, q)
                owner, part = shard.owners(p), self.part(q)
                yield np.stack([owner, self.item[part], p - shard.first[owner], q - self.first[part] + self.start[part], size], 1)
                a = b


def build(benchmark: DataFrame, rules: Rules = Rules()) -> list:
    """Broadcast blocks of the benchmark; the driver holds one partition of its rows and one block at a time."""
    context = benchmark.sparkSession.sparkContext
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null").distinct()
    out, ids, parts, starts, size = [], [], [], [], 0

    def close() -> None:
        nonlocal ids, parts, starts, size
        if ids:
            out.append(context.broadcast(Block(ids, parts, starts, rules.window)))
        ids, parts, starts, size = [], [], [], 0

    step = max(rules.block_words - rules.window + 1, 1)
    for row in own.orderBy("item_id", "text").toLocalIterator():
        words = Words(*C.utf8(pa.array([row.text], pa.large_string()))).hashes
        for a in range(0, max(len(words) - rules.window + 1, min(len(words), 1)), step):
            part = words[a : a + step + rules.window - 1]
            if size and size + len(part) > rules.block_words:
                close()
            ids.append(row.item_id)
            parts.append(part)
            starts.append(a)
            size += len(part)
    close()
    return out


def each(blocks: list):
    """The blocks, one in memory at a time."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1 and getattr(block, "_path", None):
            block.__dict__.pop("_value", None)  # it is read from its file again for the next shard


# ---------------------------------------------------------------- shards
class Found:
    """What one shard has: hits of all blocks, and with ``full`` the items and the longest match of each text."""

    def __init__(self, shard: Shard, blocks: list, rules: Rules, full: bool = False):
        change = np.zeros(len(shard.text) + 1, np.int64)
        self.items: dict[int, set[str]] = {}
        self.longest: dict[int, tuple[int, int, str]] = {}
        for block in each(blocks):
            hits = []
            for which, at in block.search(shard):
                np.add.at(change, at, 1)
                np.add.at(change, at + block.size[which], -1)
                if full:
                    hits.append(at)
                    pairs = np.unique(shard.owners(at) * len(block.at) + which)
                    owner, which = pairs // len(block.at), pairs % len(block.at)
                    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
                    for a, b in zip(edge[:-1], edge[1:], strict=True):
                        own = self.items.setdefault(int(owner[a]), set())
                        for w in which[a:b]:
                            own.update([block.ids[k] for k in block.items[block.items_from[w] : block.items_from[w + 1]]])
            if hits:
                at = np.unique(np.concatenate(hits))
                size, place = block.longest(shard, at)
                owner = shard.owners(at)
                order = np.lexsort((at, -size, owner))
                for k in order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])].tolist():
                    best = (int(size[k]), int(shard.first[owner[k]] - at[k]), block.ids[block.item[block.part(place[k])]])
                    self.longest[int(owner[k])] = max(self.longest.get(int(owner[k]), best), best, key=lambda x: x[:2])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        self.n_words = shard.n
        self.n_hit = hit[shard.first + shard.n] - hit[shard.first]
        self.contaminated = (self.n_hit > 0) & (100 * self.n_hit >= rules.min_percent * self.n_words)


ARRAYS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("text", pa.binary()), ("order", pa.binary())])


#: A row is megabytes long: writers and readers hold few of them.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def arrays(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row a shard: its documents, words and suffix array. A table in the shared folder."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for i, j in C.pieces(column, rules.shard_bytes):
                s = Shard.of(column[i:j])
                text = s.text.astype("<u2") if len(s.vocabulary) < 1 << 16 else s.text.astype("<u4")
                yield C.record(ARRAYS, [[ids[i:j].to_pylist()], [s.n], [s.vocabulary.astype("<u8").tobytes()], [text.tobytes()], [s.order.astype("<u4").tobytes()]])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return C.materialize(C.map_arrow(own, run, "doc_ids array<long>, n_words array<long>, vocabulary binary, text binary, order binary"), "suffix-arrays", **SMALL_GROUPS)


def _shards(batches):
    """(doc_ids, Shard) of the rows of an array table."""
    for batch in batches:
        for ids, n, vocabulary, text, order in zip(*(batch.column(k) for k in ARRAYS.names), strict=True):
            words = np.frombuffer(vocabulary.as_buffer(), "<u8")
            yield ids.values, Shard(np.frombuffer(text.as_buffer(), "<u2" if len(words) < 1 << 16 else "<u4"), words, np.frombuffer(order.as_buffer(), "<u4").astype(np.int64), n.values.to_numpy())


NOTHING = hashlib.sha256(b"").hexdigest()


def search(shards: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """shards: a table of ``arrays``. Per document: counts, items and verdict, and the longest verbatim match with its place."""
    blocks = build(benchmark, rules)
    columns = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_at long, longest_item string"
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "n_hit", "n_items")), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_words", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())])

    def run(batches):
        for ids, shard in _shards(batches):
            f = Found(shard, blocks, rules, True)
            n = len(f.n_words)
            digest = [hashlib.sha256(",".join(sorted(f.items[k])).encode()).hexdigest() if k in f.items else NOTHING for k in range(n)]
            place = [f.longest.get(k) for k in range(n)]
            yield C.record(schema, [ids, f.n_words, f.n_hit, [len(f.items.get(k, ())) for k in range(n)], digest, f.contaminated, [x[0] if x else 0 for x in place], [-x[1] if x else None for x in place], [x[2] if x else None for x in place]])

    return C.map_arrow(shards, run, columns)


def report(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs what ``search`` gives."""
    return search(arrays(docs, rules), benchmark, rules)


def matches(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All longest verbatim matches of at least a window: where, which item, how many words. A match that crosses parts of an item longer than a block comes in parts."""
    blocks = build(benchmark, rules)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for i, j in C.pieces(column, rules.shard_bytes):
                shard = Shard.of(column[i:j])
                for block in each(blocks):
                    for rows in block.matches(shard):
                        if len(rows):
                            yield C.record(schema, [ids.take(pa.array(rows[:, 0] + i)), [block.ids[k] for k in rows[:, 1]], *rows[:, 2:].T])

    return C.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, item_id string, doc_word long, item_word long, n_words long")


def filtered(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. One pass: a shard's array lives while its rows are judged."""
    blocks = build(benchmark, rules)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column("text")
                bad = [Found(Shard.of(column[i:j]), blocks, rules).contaminated for i, j in C.pieces(column, rules.shard_bytes)]
                yield batch.filter(pa.array(~np.concatenate(bad)))

    return C.map_arrow(docs, run, docs.schema)


#: The report's first columns in SQL: all windows of items against all windows of documents.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS k, unnest([w[p:p + least(13, len(w)) - 1] for p in range(1, len(w) - least(13, len(w)) + 2)]) AS win FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, p, k, w[p:p + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN (SELECT DISTINCT k FROM iw) ON len(w) >= k)),
hit AS (SELECT r, p, dw.k, item FROM dw JOIN iw ON dw.win = iw.win),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS own FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(own, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN items ON d.r = items.r
"""
