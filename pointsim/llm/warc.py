"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Writing: a page whose payload of at least ``least`` bytes equals that of a page with a smaller id becomes a
revisit record of it. Each record is a gzip member of its own. Files are written by Spark's own writer, whose
committer makes them appear whole on any file system: a row is some members of about ``chunk_bytes``, and the line separator is an
empty gzip member, which readers pass over. A file has at most ``chunks_per_file`` rows, so it is bounded in bytes but for its longest
record. Record ids are unique: a record that others refer to is named by page and digest, any other also by its task and number.

Reading: each file is read from the start; a record must have a version line, its headers, the block that
Content-Length announces, the blank lines after it, and the announced digest. After a failed check the reader
searches for the next gzip magic or version line that starts a valid record, goes on from there, and logs the
bytes between as a gap. The same holds within a gzip member of several records: records before and after a failed one are
kept, also those that a truncated or damaged member still unpacks to, and the member's bytes are logged as a gap
beside them. Of a damaged member (not a truncated one) only records whose announced digest holds are kept.

Defined results: a null html is an empty payload; a null url gives no target; rows without page_id never are
what others refer to, unless no row of their payload has an id: then all are responses; of repeated rows of one
page_id and payload, one (the first by url) is the response and the others refer to their own page_id. Urls, payloads and headers are
written and read at any length; a file is in memory as a whole when it is read, and Spark reads none above 2 GB. An empty table
gives no rows. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: An empty gzip member, as text of bytes.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Rules:
    least: int = 100  # bytes of a payload that others may revisit
    level: int = 6
    chunk_bytes: int = 1_000_000  # of compressed records in a row of the writer
    chunks_per_file: int = 64


# ---------------------------------------------------------------- records
def head(fields: list[tuple[str, str | None]]) -> bytes:
    return "WARC/1.1\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def name(page_id: int | None, digest: str, more: str = "") -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:32]}{more}>"


def target(url: str | None) -> str | None:
    """A url fit for a header line: white space and control characters are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, more: str = "") -> bytes:
    """more: what makes the record's id unique, where no other record refers to it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id, digest, more)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Refers-To", None if refers_to is None else name(refers_to, digest)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return head(fields) + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


TRUNCATED, DAMAGED = "a gzip member without an end", "a damaged gzip member"


class Bad(ValueError):
    """A check that failed."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; Bad if a check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("headers without an end")
    lines = data[at:end].split(b"\r\n")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header without a colon")
        headers[key.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit() or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Bad("a header is missing")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("the block doesn't end where it should")
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Bad("the block's digest differs")
    return headers, block, stop + 4


def unpack(data: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """Content of the gzip member at ``at``, where it ends, and what is wrong with it: then the content is what could be had."""
    opened = zlib.decompressobj(31)
    out, pos = [], at
    while not opened.eof:
        piece = data[pos : pos + step]
        if not len(piece):
            return b"".join(out), pos, TRUNCATED
        try:
            out.append(opened.decompress(piece))
        except zlib.error:
            break
        pos += len(piece)
    else:
        return b"".join(out), pos - len(opened.unused_data), None
    # the piece that failed again, byte by byte, as its first part may be sound
    opened, out = zlib.decompressobj(31), []
    for k in range(at, pos, step):
        out.append(opened.decompress(data[k : k + step]))
    try:
        while True:
            out.append(opened.decompress(data[pos : pos + 1]))
            pos += 1
    except zlib.error:
        return b"".join(out), pos, DAMAGED


def records(content: bytes, sure: bool) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """Valid records of what a member holds, and why the first that isn't failed. Without ``sure`` a record must announce its digest."""
    found, pos, why = [], 0, None
    while 0 <= pos < len(content):
        try:
            headers, block, end = parse_record(content, pos)
            if not sure and not headers.get("warc-block-digest", "").startswith("sha256:"):
                raise Bad("a record without a digest in a damaged member")
            found.append((headers, block))
            pos = end
        except Bad as e:
            why = why or str(e)
            pos = content.find(VERSION, pos + 1)
    return found, why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason), in order; together they cover the file.

    Records of a member all have its start and end, and so has the gap of a member of which only some could be read."""
    view, at, n = memoryview(data), 0, len(data)
    gap, reason = -1, ""
    held, until = [], 0  # records that a member without a sound end gave, and where its unpacking stopped
    while at < n:
        found, why, end = [], "neither a gzip member nor a version line", 0
        if data[at : at + 3] == GZIP:
            content, stop, broken = unpack(view, at)
            found, why = records(content, broken != DAMAGED)
            if broken:
                why = broken
            else:
                end = stop
        elif data[at : at + len(VERSION)] == VERSION:
            try:
                headers, block, end = parse_record(data, at)
                found, why = [(headers, block)], None
                if at < until and found[0] in held:  # stored without compression in that member
                    at = end
                    continue
            except Bad as e:
                why = str(e)
        if gap >= 0 and (found or not why):
            yield "gap", gap, at, reason
            gap = -1
        for x in found:
            yield "record", at, end or stop, x
        if why and gap < 0:
            gap, reason = at, why
        if end:  # what follows is found without a search
            if why and found:
                yield "gap", at, end, why
                gap = -1
            at = end
            continue
        if found:
            held, until = found, stop
        later = [x for x in (data.find(GZIP, at + 1), data.find(VERSION, at + 1)) if x >= 0]
        at = min(later, default=n)
    if gap >= 0:
        yield "gap", gap, n, reason


# ---------------------------------------------------------------- write
def _firsts(rows: DataFrame, rules: Rules) -> DataFrame:
    """Per payload that several rows have: the smallest page_id, and how many rows have both."""
    equal = rows.where(F.col("__bytes") >= rules.least).groupBy("__digest", "page_id").agg(F.count("*").alias("n"))
    smallest = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    return equal.groupBy(F.col("__digest").alias("__same")).agg(smallest.alias("__first"), F.sum("n").alias("__n")).where("__n > 1 and __first is not null").select("__same", F.col("__first.page_id").alias("__page"), F.col("__first.n").alias("__again"))


def plan(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, html with the payload's digest, for revisits the page that they refer to, and whether others may refer to the row."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(html, 256).alias("__digest"), F.octet_length(html).alias("__bytes"))
    firsts = C.materialize(_firsts(rows, rules), "payloads")
    rows = rows.join(firsts, F.col("__digest") == F.col("__same"), "left")
    first = F.col("page_id").eqNullSafe(F.col("__page"))
    refers = F.when(F.col("__page").isNotNull() & ~first, F.col("__page"))
    names = ["page_id", "url", "html", F.col("__digest").alias("digest")]
    referred = F.coalesce(first & F.col("__page").isNotNull(), F.lit(False)).alias("referred")
    again = first & (F.col("__again") > 1)
    if firsts.where("__again > 1").isEmpty():
        return rows.select(*names, refers.alias("refers_to"), referred)
    # one of the rows that repeat a page: the least by url and place, without a group in one task
    repeated = C.materialize(rows.where(again).withColumn("__place", F.monotonically_increasing_id()), "repeated")
    one = repeated.groupBy("__digest").agg(F.min(F.struct("url", "__place")).alias("__one")).select(F.col("__one.__place").alias("__one"))
    repeated = repeated.join(one, F.col("__place") == F.col("__one"), "left").select(*names, F.when(F.col("__one").isNull(), F.col("__page")).alias("refers_to"), F.col("__one").isNotNull().alias("referred"))
    single = rows.where(~F.coalesce(again, F.lit(False))).select(*names, refers.alias("refers_to"), referred)
    return single.unionByName(repeated)


def write(pages: DataFrame, path: str, rules: Rules = Rules()) -> None:
    """Write a record a row into archives in ``path``."""
    schema = pa.schema([("member", pa.binary())])

    def run(batches):
        info = head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n"
        task = TaskContext.get().partitionId()
        held, size, chunks, records = [], 0, 0, 0

        def chunk():
            nonlocal held, size, chunks
            start = [member(info, rules.level)] if chunks % rules.chunks_per_file == 0 else []
            out = b"".join([*start, *held])
            held, size, chunks = [], 0, chunks + 1
            return C.record(schema, [[out]])

        for batch in batches:
            for i, j in C.pieces(batch.column("html"), 4_000_000):
                for page_id, url, html, digest, refers_to, referred in zip(*(batch.column(k)[i:j].to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "referred")), strict=True):
                    records += 1
                    held.append(member(make_record(page_id, url, (html or "").encode(), digest, refers_to, "" if referred else f":{task}.{records}"), rules.level))
                    size += len(held[-1])
                    if size >= rules.chunk_bytes:
                        yield chunk()
        if held:
            yield chunk()

    members = C.map_arrow(plan(pages, rules), run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rules.chunks_per_file).text(path)


# ---------------------------------------------------------------- read
COLUMNS = "file string, kind string, start long, end long, reason string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]+>", urn or "")
    return int(found[1]) if found else None


def _row(file: str, start: int, end: int, headers: dict[str, str], block: bytes, payload: bool) -> tuple | None:
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    body = block.partition(b"\r\n\r\n")[2]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(headers.get("x-payload-length", len(body)))
    if kind == "response":
        own = hashlib.sha256(body).hexdigest()
        if digest and own != digest:
            raise Bad("the payload's digest differs")
        digest, size = own, len(body)
    page = headers.get("x-page-id")
    return file, "record", start, end, None, int(page) if page else None, headers.get("warc-target-uri"), body if payload and kind == "response" else None, size, digest, kind, _page(headers.get("warc-refers-to"))


def scan(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and gaps of all archives in ``path``. A revisit's payload is its response's: join on refers_to."""
    schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for kind, start, end, x in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((file, kind, start, end, x, *[None] * 7))
                    else:
                        try:
                            row = _row(file, start, end, *x, payload)
                        except (Bad, ValueError) as e:
                            row = (file, "gap", start, end, str(e), *[None] * 7)
                        if row is not None:
                            rows.append(row)
                    size += end - start if payload else 200
                    if size > 1_000_000:
                        yield C.record(schema, [list(c) for c in zip(*rows, strict=True)])
                        rows, size = [], 0
                if rows:
                    yield C.record(schema, [list(c) for c in zip(*rows, strict=True)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return C.map_arrow(files, run, COLUMNS)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return scan(spark, path, payload).where("kind = 'record'").drop("kind", "reason")


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """Quarantined bytes: file, start, end, reason."""
    return scan(spark, path, False).where("kind = 'gap'").select("file", "start", "end", "reason")


def round_trip(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: a row a page."""
    path = C.shared_path(pages.sparkSession, "warc")
    write(pages, path, rules)
    return read(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM rows),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> m THEN m END AS refers_to
FROM first
"""
