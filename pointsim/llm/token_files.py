"""Token-ID output: Simple-8b blocks in binary files, in ascending doc_id order.

A 64-bit word holds a 4-bit selector and n ids of 60 // n bits. Ids that need more than ESCAPE_BITS
bits are packed as the escape value (all ones), their true values follow in the block's escape list;
so one rare large id doesn't widen its neighbours. Every document starts on a new word, and a block lists each
document's id, first word, first id and first escape, so any document or the whole block decodes by
array operations.

File: blocks, each followed by SEPARATOR, then a footer with the blocks' offsets and lengths. Files
are written by Spark's own writer (its committer makes them appear whole, on any file system, and
lost tasks leave nothing behind); a row is a block, the line separator is SEPARATOR. A file has at most
``blocks_per_file`` blocks, about 30 MB, whatever its range of doc_ids holds. Files are read once: their totals come from the rows read.

Block, little-endian: magic S8BK, n_docs, n_ids, n_words, n_escapes (u32 each), then doc_id i64[n_docs],
has_id u8[n_docs], first word, first id, first escape u32[n_docs + 1] each, words u64, escapes u32.

Defined results: a null or empty text is its end id alone; null doc_ids come first; rows of one doc_id
stay rows of their own, by the hash of their text; a long text is encoded whole and makes a block longer; an empty table gives no
rows. Extra columns are never read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .token_cache import encoder

SEPARATOR = b"\n--simple8b--\n"
MAGIC, END = b"S8BK", b"S8BF"
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = 60 // COUNTS
ESCAPE_BITS = 15
ESCAPE = (1 << ESCAPE_BITS) - 1


@dataclass(frozen=True)
class Format:
    tokenizer: str
    end_id: int = 2
    block_ids: int = 1 << 16
    blocks_per_file: int = 255


# ---------------------------------------------------------------- codec
def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)


def _or_later(a: np.ndarray, by: int) -> np.ndarray:
    """The larger of each value and the one ``by`` places on."""
    out = a.copy()
    if 0 < by < len(a):
        np.maximum(out[:-by], a[by:], out=out[:-by])
    return out


def encode_docs(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """docs: ids as little-endian u32. Words, escapes, and first word, id and escape of each document (n + 1)."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    n = len(ids)
    first_id = np.concatenate([[0], np.cumsum([len(d) // 4 for d in docs])]).astype(np.int64)
    big = ids >= ESCAPE
    escapes = ids[big]
    values = np.where(big, np.uint32(ESCAPE), ids).astype(np.uint64)
    width = _widths(values)
    # fits[k][i]: COUNTS[k] values from i on fit, within their document; best[i]: the largest such k
    left = np.repeat(first_id[1:], np.diff(first_id)) - np.arange(n)
    best = np.zeros(n, np.uint8)
    most = {1: width}
    reach = 1
    for k, count in enumerate(COUNTS):
        while reach * 2 <= count:
            most[2 * reach] = _or_later(most[reach], reach)
            reach *= 2
        top = _or_later(most[reach], count - reach)
        best[(top <= WIDTHS[k]) & (left >= count)] = k
    # greedy choice: each word takes as many ids as fit
    step = COUNTS[best].astype(np.uint8).tobytes()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    starts = np.asarray(starts, np.int64)
    selector = best[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    for k in np.unique(selector):
        own = np.flatnonzero(selector == k)
        at = starts[own]
        packed = np.zeros(len(own), np.uint64)
        for j in range(COUNTS[k]):
            packed |= values[at + j] << np.uint64(j * WIDTHS[k])
        words[own] |= packed
    first_word = np.searchsorted(starts, first_id)
    first_escape = np.concatenate([[0], np.cumsum(big)])[first_id]
    return words, escapes, first_word, first_id, first_escape


def decode_words(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Ids of whole documents."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint32)
    for k in np.unique(selector):
        own = np.flatnonzero(selector == k)
        mask = np.uint64((1 << int(WIDTHS[k])) - 1)
        for j in range(COUNTS[k]):
            out[at[own] + j] = (words[own] >> np.uint64(j * WIDTHS[k])) & mask
    out[out == ESCAPE] = escapes
    return out


def pack_block(ids: list[int | None], docs: list[bytes]) -> bytes:
    words, escapes, *firsts = encode_docs(docs)
    head = MAGIC + struct.pack("<4I", len(docs), len(b"".join(docs)) // 4, len(words), len(escapes))
    known = np.array([x is not None for x in ids], np.uint8)
    return b"".join([head, np.array([x or 0 for x in ids], "<i8").tobytes(), known.tobytes(), *(f.astype("<u4").tobytes() for f in firsts), words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()])


class Block:
    """A block's arrays, as views of its bytes."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 4] != MAGIC:
            raise ValueError("not a block")
        n, self.n_ids, n_words, n_escapes = struct.unpack_from("<4I", data, at + 4)
        at += 20
        parts = []
        for kind, k in (("<i8", n), ("u1", n), *(("<u4", n + 1),) * 3, ("<u8", n_words), ("<u4", n_escapes)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        self.ids, self.known, self.first_word, self.first_id, self.first_escape, self.words, self.escapes = parts
        self.end = at

    def doc(self, k: int) -> np.ndarray:
        """Ids of one document, without its neighbours."""
        return decode_words(self.words[self.first_word[k] : self.first_word[k + 1]], self.escapes[self.first_escape[k] : self.first_escape[k + 1]])


def file_blocks(data: bytes):
    """Blocks of a file, by its footer."""
    if not data:
        return
    end = len(data) - len(SEPARATOR)
    (at,) = struct.unpack_from("<Q", data, end - 8)
    if data[at : at + 4] != END:
        raise ValueError("no footer")
    (n,) = struct.unpack_from("<I", data, at + 4)
    for start in np.frombuffer(data, "<u8", n, at + 8):
        yield Block(data, int(start))


# ---------------------------------------------------------------- write and read
def write(docs: DataFrame, path: str, form: Format) -> None:
    """Write doc_id and text of docs as token files in ``path``, in ascending order of doc_id."""

    def run(batches):
        made = encoder(form.tokenizer)
        tail = np.array([form.end_id], "<u4").tobytes()
        schema = pa.schema([("block", pa.binary())])
        offsets, at, ids, parts, size = [], 0, [], [], 0

        def closed(last: bool):
            """The block, and the footer where the file is full or ends."""
            nonlocal offsets, at, ids, parts, size
            if parts:
                block = pack_block(ids, parts)
                offsets.append(at)
                at += len(block) + len(SEPARATOR)
                ids, parts, size = [], [], 0
                yield C.record(schema, [[block]])
            if len(offsets) == form.blocks_per_file or last and offsets:
                yield C.record(schema, [[END + struct.pack("<I", len(offsets)) + np.array(offsets, "<u8").tobytes() + struct.pack("<Q", at)]])
                offsets, at = [], 0

        for batch in batches:
            for i, j in C.pieces(batch.column("text"), 500_000):
                for k, own in zip(batch.column("doc_id")[i:j].to_pylist(), made.encode_many(batch.column("text")[i:j]), strict=True):
                    ids.append(k)
                    parts.append(own.astype("<u4", copy=False).tobytes() + tail)
                    size += len(own) + 1
                    if size >= form.block_ids:
                        yield from closed(False)
        yield from closed(True)

    tie = F.xxhash64("text")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("__tie", tie)
    own = own.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    blocks = C.map_arrow(own, run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", form.blocks_per_file + 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files in ``path``: file, place in it, doc_id, offset of its first id in the file, n_tokens, crc32 of its ids."""
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                place = offset = 0
                for block in file_blocks(content.as_buffer()):
                    ids = decode_words(block.words, block.escapes)
                    if len(ids) != block.n_ids:
                        raise ValueError(f"{name}: a block has {len(ids)} ids, not {block.n_ids}")
                    bounds = block.first_id.astype(np.int64)
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    n = len(crc)
                    yield C.record(schema, [[name] * n, np.arange(place, place + n), pa.array(block.ids.astype(np.int64), mask=block.known == 0), bounds[:-1] + offset, np.diff(bounds), crc])
                    place += n
                    offset += block.n_ids

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return C.map_arrow(files, run, "file string, place long, doc_id long, offset long, n_tokens long, ids_crc32 long")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files in ``path``, in order: doc_id, start (ids of all documents before), n_tokens, ids_crc32, file, place.

    Files are summed up in order of their numbers; documents add their offset within the file.
    """
    number = lambda c, mark: F.regexp_extract(c, mark, 1).cast("bigint")
    own = C.materialize(read(spark, path), "token-rows")
    files = own.groupBy("file").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("ids"))
    files = files.select(F.col("file").alias("__file"), "ids", number("file", "part-([0-9]+)").alias("part"), number("file", "-c([0-9]+)[.][^/-]*$").alias("cut"))
    files = C.summed_before(files, [F.asc("part"), F.asc("cut")], {"__before": F.col("ids")}, "token-files")
    name = F.concat_ws("-", F.regexp_extract("file", "(part-[0-9]+)", 1), F.regexp_extract("file", "-(c[0-9]+)[.][^/-]*$", 1))
    own = own.join(files, F.col("file") == F.col("__file"))
    return own.select("doc_id", (F.col("__before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", name.alias("file"), "place")


def encode(docs: DataFrame, form: Format) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    path = C.shared_path(docs.sparkSession, "tokens")
    write(docs, path, form)
    return index(docs.sparkSession, path)
