"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets are one node; only nodes go on.
2. Min-max hashing: under each permutation both the smallest and the largest value of the set are
   kept, so a signature of v values takes v / 2 evaluations a shingle. ``rows`` values make a band; there
   are as many bands as leave a pair at the threshold unseen with a probability of ``miss``.
3. Nodes that share a band are tied to the smallest node of it (a star, never all pairs); the
   connected components of those stars, families, hold every candidate pair.
4. Links are confirmed on full sets. A small family is one piece of work. A large one is dealt in chunks over
   the cluster and compared with pivots, in rounds: nodes that a pivot links, and that no pivot of another
   class is near, are done (Jaccard distance is a metric: whatever they could link to, a pivot would be near
   them); the rest give the next pivots, until none is left. No link between candidates is lost. Nodes that are done
   are still compared with later pivots: such a pivot may link to them without having been near a pivot's links itself.

Defined results: texts without words have empty sets and are linked with nothing; fewer words than a shingle
make one shingle; repeated rows share a component, and rows of one doc_id are the same document; rows without
doc_id take part in linking, have a null component_id where no linked row has an id, and are then kept.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

NO_ID = 1 << 62


@dataclass(frozen=True)
class Rules:
    shingle: int = 5
    percent: int = 80
    rows: int = 6  # values of a band: a minimum and a maximum for each of rows / 2 permutations
    miss: float = 1e-6
    seed: int = 11
    chunk: int = 256  # nodes of a large family that a task compares at a time
    chunk_bytes: int = 16_000_000
    pivots: int = 2048  # of a large family in a round, or an eighth of what waits, within pivot_bytes of text
    pivot_bytes: int = 32_000_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


# ---------------------------------------------------------------- sets and signatures
class Sets:
    """Sorted distinct shingle hashes of each text: hashes[first[k]:first[k + 1]]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, shingle: int):
        n = len(offsets) - 1
        low = C.LOWER[raw]
        starts, ends = C.spans(C.NOT_SPACE[low])
        words = C.Sums(low).hashes(starts, ends)
        owner = np.searchsorted(offsets, starts, "right") - 1
        count = np.bincount(owner, minlength=n)
        at, hashes = C.windows(owner, words, shingle)
        owners = owner[at]
        for k in range(1, shingle):  # whole texts of fewer words
            short, h = C.windows(owner, words, k)
            whole = count[owner[short]] == k
            if whole.any():
                owners, hashes = np.concatenate([owners, owner[short[whole]]]), np.concatenate([hashes, C.mix(h[whole] + np.uint64(k))])
        if len(owners) and (owners[1:] < owners[:-1]).any():
            order = np.argsort(owners, kind="stable")
            owners, hashes = owners[order], hashes[order]
        size = np.bincount(owners, minlength=n)
        edge = np.concatenate([[0], np.cumsum(size)])
        for k in np.flatnonzero(size > 1):
            hashes[edge[k] : edge[k + 1]].sort()
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        self.hashes = hashes[fresh]
        self.size = np.bincount(owners[fresh], minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def keys(self) -> list[bytes | None]:
        """128-bit digest of each set; None if empty."""
        return [hashlib.blake2b(self.hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]

    def bands(self, rules: Rules) -> np.ndarray:
        """Band values of the texts with a set, as (texts, bands)."""
        full = self.size > 0
        starts = self.first[:-1][full]
        out = np.zeros((len(starts), rules.bands), np.uint64)
        if not len(starts):
            return out
        x = (self.hashes >> np.uint64(32)).astype(np.uint32)
        draw = np.random.Generator(np.random.PCG64(rules.seed))
        half = max(rules.rows // 2, 1)
        a = draw.integers(0, 1 << 31, (rules.bands, half), np.uint32) * np.uint32(2) + np.uint32(1)
        b = draw.integers(0, 1 << 32, (rules.bands, half), np.uint64).astype(np.uint32)
        v = np.empty_like(x)
        for band in range(rules.bands):
            h = np.full(len(starts), band + 1, np.uint64)
            for k in range(half):
                np.multiply(x, a[band, k], out=v)
                v += b[band, k]
                low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h = C.mix(h + (low.astype(np.uint64) << np.uint64(32) | high))
            out[:, band] = h
        return out


def node_id() -> Column:
    """doc_id, or for rows without one a number of 2**62 or more from the text."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def signatures(docs: DataFrame, rules: Rules) -> DataFrame:
    """Per row: doc_id, nid, n_shingles, set_key, bands (empty sets: no key, no bands)."""
    schema = pa.schema([("doc_id", pa.int64()), ("nid", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, nids, text = batch.column("doc_id"), batch.column("nid"), batch.column("text")
            for i, j in C.pieces(text):
                s = Sets(*C.utf8(text[i:j]), rules.shingle)
                bands = s.bands(rules)
                edge = np.concatenate([[0], np.cumsum(np.where(s.size > 0, rules.bands, 0))]).astype(np.int32)
                yield C.record(schema, [ids[i:j], nids[i:j], s.size, s.keys(), pa.ListArray.from_arrays(edge, bands.ravel().view(np.int64))])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), node_id().alias("nid"), "text")
    return C.map_arrow(own, run, "doc_id long, nid long, n_shingles long, set_key binary, bands array<long>")


# ---------------------------------------------------------------- links
class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


class Pivots:
    """Inverted index of some sets, for exact counts of what another set shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.hashes, own, "left")
        n = np.searchsorted(self.hashes, own, "right") - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.bincount(self.owner[at], minlength=len(self.size))

    def at_least(self, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which sets reach percent, and which reach the percent that leaves room for two such links in a row."""
        inter = self.shared(own)
        union = self.size + len(own) - inter
        return np.flatnonzero(100 * inter >= percent * union), np.flatnonzero(100 * inter >= (2 * percent - 100) * union)


def _sets(texts: list[str], shingle: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    s = Sets(*C.utf8(pa.array(texts, pa.large_string())), shingle)
    return [s.hashes[a:b] for a, b in zip(s.first[:-1], s.first[1:], strict=True)], s.keys()


def _own_rows(rows: dict[str, list], shingle: int) -> tuple[list[int], list[np.ndarray]]:
    """Places and sets of the rows whose text has the set that names the node, one of each node."""
    sets, keys = _sets(rows["text"], shingle)
    first: dict[int, int] = {}
    for k, node in enumerate(rows["node"]):
        if keys[k] == rows["set_key"][k]:
            first.setdefault(node, k)
    return list(first.values()), [sets[k] for k in first.values()]


def _groups(batches, names: tuple[str, ...]):
    """Rows of equal ``names`` in a row, as columns; the input is sorted by them."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True))
        edge = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(edge, edge[1:], strict=False):
            if keys[a] != now:
                if held:
                    yield now, held
                held, now = {k: [] for k in batch.schema.names}, keys[a]
            part = batch.slice(a, b - a)
            for k in held:
                held[k] += part.column(k).to_pylist()
    if held:
        yield now, held


def small_families(members: DataFrame, rules: Rules) -> DataFrame:
    """members: family, node, set_key, text. Per node: node, component."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches):
        for _, rows in _groups(batches, ("family",)):
            at, sets = _own_rows(rows, rules.shingle)
            union, index = Union(len(at)), Pivots(sets)
            for k, own in enumerate(sets):
                for j in index.at_least(own, rules.percent)[0].tolist():
                    union.join(k, j)
            nodes = [rows["node"][k] for k in at]
            least: dict[int, int] = {}
            for k, node in enumerate(nodes):
                least[union.find(k)] = min(node, least.get(union.find(k), node))
            yield C.record(schema, [nodes, [least[union.find(k)] for k in range(len(nodes))]])

    dealt = members.repartition("family").sortWithinPartitions("family")
    return C.map_arrow(dealt, run, "node long, component long")


def large_families(members: DataFrame, rules: Rules, held: C.Scratch) -> DataFrame:
    """members: family, chunks, node, set_key, text of families of several chunks. Links that span each component: a, b.

    A node's label is a node of its component, as far as is known. A node is covered if a pivot links it, and open if a pivot
    that isn't known to be of its component is so near that something between could link them; nodes that are open or not
    covered wait to be pivots themselves.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("label", pa.int64()), ("covered", pa.bool_()), ("open", pa.bool_())])

    def run(batches):
        for _, rows in _groups(batches, ("family", "salt")):
            is_pivot = rows["pivot"]
            pivots, docs = ({k: [x for x, p in zip(v, is_pivot, strict=True) if p is want] for k, v in rows.items()} for want in (True, False))
            at, sets = _own_rows(pivots, rules.shingle)
            own, own_sets = _own_rows(docs, rules.shingle)
            names, labels = [pivots["node"][k] for k in at], [pivots["label"][k] for k in at] + [docs["label"][k] for k in own]
            index, n = Pivots(sets), len(at)
            union = Union(n + len(own))
            seen: dict[int, int] = {}
            for k, label in enumerate(labels):
                union.join(seen.setdefault(label, k), k)
            place = {node: k for k, node in enumerate(names)}
            a, b, covered, near = [], [], [], []
            for k, i in enumerate(own):
                node = docs["node"][i]
                if node in place:
                    union.join(place[node], n + k)
                link, close = index.at_least(own_sets[k], rules.percent)
                link = [j for j in link.tolist() if names[j] != node]
                for j in link:
                    if union.join(n + k, j):
                        a.append(node)
                        b.append(names[j])
                covered.append(docs["covered"][i] or bool(link))
                near.append(close.tolist())
            least: dict[int, int] = {}
            for k, label in enumerate(labels):
                root = union.find(k)
                least[root] = min(label, least.get(root, label))
            flag = []
            for k, i in enumerate(own):
                done = docs["done"][i] or docs["node"][i] in place
                flag.append(not done and (not covered[k] or docs["open"][i] or any(union.find(j) != union.find(n + k) for j in near[k])))
            nodes, none = [docs["node"][i] for i in own], [None] * len(a)
            yield C.record(schema, [a + nodes, b + [None] * len(nodes), none + [least[union.find(n + k)] for k in range(len(own))], none + covered, none + flag])

    members = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("chunks")))
    state = members.select("node", "family", F.octet_length("text").cast("bigint").alias("bytes"), F.col("node").alias("label"), F.lit(False).alias("covered"), F.lit(True).alias("open"), F.lit(False).alias("done"))
    links, rounds = None, 0
    while True:
        rounds += 1
        waiting = state.where("open and not done").select("node", "family", "bytes")
        left = waiting.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"))
        most = F.least(F.greatest(F.lit(rules.pivots), F.col("n") / 8), F.greatest(F.lit(rules.pivot_bytes) * F.col("n") / F.greatest("all_bytes", F.lit(1)), F.lit(1.0)))
        draw = F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        chosen = waiting.join(left, "family").where(draw < most / F.col("n")).select("node", F.lit(True).alias("pivot"))
        state = held.put(state.join(chosen, "node", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False))).withColumn("open", F.col("open") & F.lit(rounds > 1)), "state")
        rows = members.join(state.drop("family"), "node")
        names = ["family", "salt", "pivot", "node", "set_key", "text", "label", "covered", "open", "done"]
        # each row as a document of its chunk, and each pivot once more for every chunk
        salts = F.when(F.col("pivot"), F.concat(F.array(F.lit(-1).cast("bigint")), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).otherwise(F.array(F.lit(-1).cast("bigint")))
        both = rows.withColumn("__to", F.explode(salts)).withColumn("pivot", F.col("__to") >= 0).withColumn("salt", F.when(F.col("__to") >= 0, F.col("__to")).otherwise(F.col("salt"))).select(names)
        dealt = both.repartition("family", "salt").sortWithinPartitions("family", "salt")
        out = held.put(C.map_arrow(dealt, run, "a long, b long, label long, covered boolean, open boolean"), "round")
        fresh = out.where("b is not null").select("a", "b")
        links = fresh if links is None else links.unionByName(fresh)
        found = out.where("b is null").select(F.col("a").alias("node"), "label", "covered", "open")
        if found.where("open").isEmpty():
            return links
        state = state.select("node", "family", "bytes", (F.col("done") | F.col("pivot")).alias("done")).join(found, "node")


# ---------------------------------------------------------------- operator
def classes(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: doc_id, nid, n_shingles, component_id, kept. A written table; what led to it is removed."""
    with C.Scratch(docs.sparkSession) as held:
        return C.materialize(_classes(docs, rules, held), "classes")


def _classes(docs: DataFrame, rules: Rules, held: C.Scratch) -> DataFrame:
    rows = held.put(signatures(docs, rules), "signatures")
    # equal sets are one node; first() is the same for all of them
    nodes = held.put(rows.where("set_key is not null").groupBy("set_key").agg(F.min("nid").alias("node"), F.first("bands").alias("bands")), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    stars = bands.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = bands.join(stars, "band").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    family = components(ties, held)
    # each node and each component's own; summed up before the shuffle, so that a large component's node isn't hot
    both = F.explode(F.array(F.struct("node", "component"), F.struct(F.col("component").alias("node"), "component")))
    family = family.select(both.alias("__e")).groupBy("__e.node").agg(F.min("__e.component").alias("family"))
    texts = docs.select(node_id().alias("node"), "text")
    family = family.join(nodes.select("node", "set_key"), "node").hint("shuffle_hash")
    members = held.put(texts.join(family, "node").select("family", "node", "set_key", "text"), "members")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / rules.chunk), F.ceil(F.sum(F.octet_length("text")) / rules.chunk_bytes)).cast("bigint").alias("chunks"))
    sizes = held.put(sizes.where("chunks > 1"), "large")
    if sizes.isEmpty():
        linked = small_families(members, rules)
    else:
        linked = small_families(members.join(sizes, "family", "left_anti"), rules)
        linked = linked.unionByName(components(large_families(members.join(sizes, "family"), rules, held), held))
    linked = linked.where("node <> component")
    named = nodes.select("set_key", "node").join(linked, "node", "left").select(F.col("set_key").alias("__key"), F.coalesce("component", "node").alias("component"))
    out = rows.drop("bands").join(named, F.col("set_key") == F.col("__key"), "left").withColumn("component", F.coalesce("component", "nid"))
    named_id = F.when(F.col("component") < NO_ID, F.col("component"))
    return out.select("doc_id", "nid", "n_shingles", named_id.alias("component_id"), F.coalesce(F.col("doc_id") == named_id, F.col("doc_id").isNull() & named_id.isNull()).alias("kept"))


def filtered(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One document of each component, with all columns of docs; of rows of one doc_id, one."""
    found = classes(docs, rules)
    kept = found.where("kept").groupBy("nid").agg((F.count("*") > 1).alias("__again")).withColumnRenamed("nid", "__nid")
    # ids grow with the documents: hashed by partition at every size, never broadcast; texts aren't sorted
    rows = docs.withColumn("__own", node_id()).join(kept.hint("shuffle_hash"), F.col("__own") == F.col("__nid"))
    if kept.where("__again").isEmpty():
        return rows.select(docs.columns)
    again = rows.where("__again").groupBy("__own").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return rows.where("not __again").select(docs.columns).unionByName(again)


#: The classes by 3 words and 0.85 in SQL: shared shingles of all pairs, and what is reachable by links.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[p:p + 2] for p in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, c FROM r JOIN links ON doc = x),
least AS (SELECT doc, min(c) AS c FROM r GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c::BIGINT AS component_id, d.doc_id = c AS kept FROM d JOIN least ON d.doc_id = doc LEFT JOIN n ON n.doc_id = d.doc_id
"""
