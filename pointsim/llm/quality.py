"""Quality rules: text measures with fixed limits, and a trained n-gram classifier.

The classifier is a logistic regression over hashed word n-grams (1 and 2 words) and hashed n-grams of 4
characters (code points), fitted on a bounded sample of labelled rows, with probabilities calibrated (Platt) on
rows held out of the fit, for classes of equal size. Documents are scored in Arrow batches against a fixed threshold. Weights are whole numbers of
2**-16, so a document's score doesn't depend on its batch.

The sample: at most ``max_rows`` labelled documents, one row of each doc_id (the least text), and the first ``max_chars``
characters of each; it bounds what the driver holds, and the fit alone. Scores take whole texts, of any length.

Defined results: a null or blank text has no words and fails the base rules; a null label is not used, of several labels of one
doc_id the least; labels of one class, or none, give no model and the base rules decide alone; repeated rows are judged alike,
each on its own; ties of a probability with the threshold are kept; an empty table gives no rows. Extra columns are never read,
and ``filtered`` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
SIZE = 1 << BITS
ONE = 1 << 16
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the classifier. max_rows and max_chars bound the labelled sample of the fit."""

    min_words: int = 10
    max_repeat_percent: int = 20
    threshold: float = 0.05
    max_rows: int = 2400
    max_chars: int = 100_000
    seed: int = 7
    rounds: int = 80


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # int32: word part, then character part
    bias: float
    slope: float  # calibration: p = sigmoid(slope * score + shift)
    shift: float

    def probability(self, word_sum, n_word, char_sum, n_char):
        score = self.bias + word_sum / ONE / np.maximum(n_word, 1) + char_sum / ONE / np.maximum(n_char, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


class Text:
    """A piece of a batch: bytes, words and their owners."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1
        self.inside = C.NOT_SPACE[raw]
        self.starts, self.ends = C.spans(self.inside)
        self.owner = np.searchsorted(offsets, self.starts, "right") - 1
        self.sums = C.Sums(raw)
        self.words = self.sums.hashes(self.starts, self.ends)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def n_words(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n)

    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        line = self.raw != 10
        line[self.offsets[1:] - 1] = False  # the space that ends each text
        starts, ends = C.spans(line)
        words = np.concatenate([[0], np.cumsum(self.inside)])
        full = words[ends] > words[starts]
        starts, ends = starts[full], ends[full]
        owner = np.searchsorted(self.offsets, starts, "right") - 1
        key = C.mix(self.sums.hashes(starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        return np.bincount(owner[again], minlength=self.n)

    def n_repeat_words(self, k: int = 5) -> np.ndarray:
        """Words in windows of k words that their text has twice or more."""
        at, h = C.windows(self.owner, self.words, k)
        if not len(at):
            return np.zeros(self.n, np.int64)
        key = C.mix(h + self.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        at = at[order[same[1:] | same[:-1]]]
        change = np.zeros(len(self.owner) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + k, -1)
        return np.bincount(self.owner[np.cumsum(change)[:-1] > 0], minlength=self.n)

    def word_features(self) -> tuple[np.ndarray, np.ndarray]:
        """(owner, index) of word 1-grams and 2-grams."""
        at, pairs = C.windows(self.owner, self.words, 2)
        shift = np.uint64(64 - BITS)
        return np.concatenate([self.owner, self.owner[at]]), np.concatenate([self.words >> shift, pairs >> shift]).astype(np.int64)

    def char_features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each n-gram of 4 characters, and each text's first and last + 1."""
        at = np.flatnonzero((self.raw & 0xC0) != 0x80)  # where characters start
        edge = np.concatenate([at, [len(self.raw)]])
        grams = (self.sums.hashes(at[:-3], edge[4:]) >> np.uint64(64 - BITS)).astype(np.int64) if len(at) > 3 else np.zeros(0, np.int64)
        first = np.minimum(np.searchsorted(at, self.offsets[:-1]), len(grams))
        last = np.maximum(first, np.searchsorted(at, self.offsets[1:]) - 4)  # without the space at the end
        return grams, first, last


# ---------------------------------------------------------------- fit
def _matrix(column: pa.Array):
    """Word and character features of all rows as (owner, index, share)."""
    owners, index, share = [], [], []
    for i, j in C.pieces(column):
        t = Text(*C.utf8(column[i:j]))
        grams, first, last = t.char_features()
        n = last - first
        for shift, own, idx in ((0, *t.word_features()), (SIZE, np.repeat(np.arange(t.n), n), grams[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])):
            key, count = np.unique(own.astype(np.int64) << 20 | idx, return_counts=True)
            own = key >> 20
            owners.append(own + i)
            index.append((key & (1 << 20) - 1) + shift)
            share.append((count / np.bincount(own, count, t.n)[own]).astype(np.float32))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(owners), np.concatenate(index), np.concatenate(share)


def train(texts: pa.Array, labels: np.ndarray, rules: Rules = Rules()) -> Model | None:
    """Logistic regression by full-batch Adam; every fifth row is held out for the calibration."""
    labels = np.asarray(labels, np.float64)
    n = len(labels)
    if n < 10 or labels.min() == labels.max():
        return None
    owner, index, share = _matrix(texts)
    held = np.arange(n) % 5 == 4
    if any(len(set(labels[x])) < 2 for x in (held, ~held)):
        held = np.zeros(n, bool)
    weight = np.where(labels == 1, 0.5 / max(labels[~held].sum(), 1), 0.5 / max((1 - labels[~held]).sum(), 1)) * ~held
    w, bias = np.zeros(2 * SIZE), 0.0
    m, v = np.zeros(2 * SIZE), np.zeros(2 * SIZE)
    mb = vb = 0.0
    score = lambda: bias + np.bincount(owner, w[index] * share, n)
    for k in range(1, rules.rounds + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(score(), -50, 50))) - labels)
        g = np.bincount(index, error[owner] * share, 2 * SIZE) + 1e-7 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        bias -= 0.05 * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-9)
    w = np.round(np.clip(w, -3e4, 3e4) * ONE).astype(np.int64)
    w = np.clip(w, -(2**31) + 1, 2**31 - 1).astype(np.int32)
    z = bias + np.bincount(owner, w[index] / ONE * share, n)
    on = held if held.any() else np.ones(n, bool)
    slope, shift = _platt(z[on], labels[on])
    return Model(w, float(bias), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of sigmoid(slope * z + shift), by Newton steps with smoothed targets."""
    scale = max(float(np.abs(z).mean()), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        grad = x.T @ (p - t) + 1e-3 * a
        a -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(max(a[0], 1e-6) / scale), float(a[1])


def sample(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(__order, doc_id, text, __quality) of at most rules.max_rows labelled documents, half of either class where there are enough; which ones, a hash of doc_id decides."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    order = F.xxhash64("doc_id", F.lit(rules.seed))
    parts = [own.where(F.col("__quality") == q).withColumn("__order", order).orderBy("__order", "doc_id").limit(rules.max_rows // 2) for q in (0, 1)]
    drawn = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), "__quality", "__order")
    # at most max_rows rows of three numbers: a bounded broadcast
    texts = docs.select("doc_id", F.substring("text", 1, rules.max_chars).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("__order", "doc_id", "__quality").agg(F.min("text").alias("text")).select("__order", "doc_id", "text", "__quality")


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Model | None:
    """Fit on the sample."""
    table = sample(docs, labels, rules).toArrow().combine_chunks()
    if not table.num_rows:
        return None
    table = table.sort_by([("__order", "ascending"), ("doc_id", "ascending")])
    return train(table["text"].combine_chunks(), table["__quality"].to_numpy(), rules)


# ---------------------------------------------------------------- score
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def measure(raw: np.ndarray, offsets: np.ndarray, model: Model | None, rules: Rules) -> list[np.ndarray]:
    """The columns of COLUMNS for the texts of one piece."""
    t = Text(raw, offsets)
    n_words = t.n_words()
    out = [n_words, t.per_row(t.inside & ((raw & 0xC0) != 0x80)), t.per_row(SYMBOLS[raw]), t.n_dup_lines(), t.n_repeat_words()]
    failed = (n_words < rules.min_words) | (100 * out[4] > rules.max_repeat_percent * n_words)
    if model is None:
        p = np.ones(t.n)
    else:
        own, idx = t.word_features()
        word_sum = np.bincount(own, model.weights[idx], t.n)  # whole numbers below 2**53: exact
        n_word = np.bincount(own, minlength=t.n)
        grams, first, last = t.char_features()
        total = np.concatenate([[0], np.cumsum(model.weights[SIZE:][grams], dtype=np.int64)])
        p = model.probability(word_sum, n_word, total[last] - total[first], last - first)
    return [*out, failed, p, ~failed & (p >= rules.threshold)]


def _scored(batch: pa.RecordBatch, model: Model | None, rules: Rules) -> list[np.ndarray]:
    text = batch.column("text")
    parts = [measure(*C.utf8(text[i:j]), model, rules) for i, j in C.pieces(text)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _shared(docs: DataFrame, model: Model | None):
    return docs.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, model: Model | None, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: doc_id, the measures, base_failed, probability of good quality, kept."""
    held = _shared(docs, model)
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in MEASURES), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield C.record(schema, [batch.column("doc_id"), *_scored(batch, held.value, rules)])

    return C.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, f"doc_id long, {COLUMNS}")


def filtered(docs: DataFrame, model: Model | None, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    held = _shared(docs, model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scored(batch, held.value, rules)[-1]))

    return C.map_arrow(docs, run, docs.schema)
