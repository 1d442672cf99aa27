import hashlib
import random
import zlib

import duckdb
import pytest
from conftest import SF

from pointsim.llm import warc as A


def result(df):
    return sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted((False, *r) for r in con.execute(A.ORACLE).fetchall())
    assert result(A.round_trip(spark.read.parquet(f"{SF}/pages.parquet"))) == want


BIG, SHORT = "x" * 150 + "é\r\n\r\nWARC/1.1\r\n", "s" * 99


def test_copies_and_odd_rows(spark):
    rows = [(5, "u", BIG), (3, "u v\n", BIG), (9, None, BIG), (None, "n", BIG), (1, "a", SHORT), (2, "b", SHORT), (4, "e", None), (6, "f", ""), (7, "g", BIG + "7"), (7, "h", BIG + "7"), (None, "i", BIG + "8"), (None, "j", BIG + "8")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    got = A.round_trip(pages).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    big = len(BIG.encode())
    assert kinds == sorted([(5, big, "revisit", 3), (3, big, "response", None), (9, big, "revisit", 3), (0, big, "revisit", 3), (1, 99, "response", None), (2, 99, "response", None), (4, 0, "response", None), (6, 0, "response", None), (7, big + 1, "response", None), (7, big + 1, "revisit", 7), (0, big + 1, "response", None), (0, big + 1, "response", None)], key=lambda x: (*x[:3], x[3] or 0))
    assert {r.payload_digest for r in got if r.page_id in (4, 6)} == {hashlib.sha256(b"").hexdigest()}
    assert A.round_trip(pages.limit(0)).count() == 0


def archive(n, packed):
    out, ends = b"", []
    for k in range(n):
        body = f"<p>{k}</p>".encode() * 20
        record = A.make_record(k, f"http://x/{k}", body, hashlib.sha256(body).hexdigest(), None)
        out += A.member(record, 6) + A.EMPTY if packed else record
        ends.append(len(out))
    return out, [0, *ends]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    whole, edge = archive(30, packed)
    assert [x[3][0]["x-page-id"] for x in A.salvage(whole)] == [str(k) for k in range(30)]
    draw = random.Random(1)
    for _ in range(60):
        hurt = draw.randrange(1, 29)
        data = bytearray(whole)
        at = draw.randrange(edge[hurt], edge[hurt + 1] - 25)
        how = draw.randrange(3)
        if how == 0:
            data[at : at + 4] = bytes(draw.randrange(256) for _ in range(4))
        elif how == 1:
            del data[at : edge[hurt + 1] - 20]
        else:
            data[at:at] = b"\x1f\x8b\x08 WARC/1.1\r\njunk"
        found = list(A.salvage(bytes(data)))
        kept = {int(x[3][0]["x-page-id"]) for x in found if x[0] == "record"}
        assert set(range(30)) - kept <= {hurt}
        covered = 0
        for kind, start, end, _ in found:
            assert start >= covered or packed
            covered = end
        assert kept == set(range(30)) or any(x[0] == "gap" for x in found)
    assert list(A.salvage(whole[: edge[3] + 50]))[-1][0] == "gap"


def test_gaps_are_logged(spark, tmp_path):
    whole, edge = archive(5, True)
    data = whole[: edge[2] + 30] + b"\xff" * 8 + whole[edge[2] + 38 :]
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(archive(2, False)[0])
    got = A.read(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == [0, 0, 1, 1, 3, 4]
    assert {bytes(r.payload) for r in got if r.page_id == 4} == {b"<p>4</p>" * 20}
    (gap,) = A.gaps(spark, str(tmp_path)).collect()
    assert gap.start <= edge[2] + 30 < gap.end and zlib.crc32(data)


def test_headers_of_any_length(spark):
    urls = ["http://x/" + "a" * 70_000, "http://x/" + " " * 30_000, "data:," + "b" * 300_000]
    pages = spark.createDataFrame([(k, u, BIG) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in A.round_trip(pages).collect())
    assert got == [(0, "response", None), (1, "revisit", 0), (2, "revisit", 0)]
    record = A.make_record(1, urls[0], b"x", hashlib.sha256(b"x").hexdigest(), None)
    assert [x[3][0]["warc-target-uri"] for x in A.salvage(record)] == urls[:1]


@pytest.mark.parametrize("level", [0, 6])
def test_records_of_one_member(level):
    bodies = [random.Random(k).randbytes(400).hex().encode() for k in range(12)]
    parts = [A.make_record(k, f"http://x/{k}", b, hashlib.sha256(b).hexdigest(), None) for k, b in enumerate(bodies)]

    def kept(data):
        found = list(A.salvage(data))
        return [int(x[3][0]["x-page-id"]) for x in found if x[0] == "record"], [x[1:] for x in found if x[0] == "gap"]

    after = A.member(parts[11], 6)
    whole = A.member(b"".join(parts[:11]), level)
    assert kept(whole + after) == (list(range(12)), [])
    hurt = b"".join(parts[:4]) + parts[4].replace(bodies[4][:50], b"?" * 50) + b"".join(parts[5:11])
    data = A.member(hurt, level)
    assert kept(data + after) == ([0, 1, 2, 3, *range(5, 12)], [(0, len(data), "the block's digest differs")])
    ids, gaps = kept(whole[: len(whole) * 2 // 3])
    assert ids == list(range(len(ids))) and 5 <= len(ids) <= 8 and gaps == [(0, len(whole) * 2 // 3, A.TRUNCATED)]
    ids, gaps = kept(whole[:-8] + b"\0" * 8 + after)
    assert ids == list(range(12)) and gaps == [(0, len(whole), A.DAMAGED)]
    cut = len(whole) // 2
    ids, gaps = kept(whole[:cut] + after)
    assert ids[-1] == 11 and ids[:-1] == list(range(len(ids) - 1)) and len(ids) >= 5 and len(gaps) == 1


def test_ids_are_unique_and_files_are_cut_by_bytes(spark, tmp_path):
    noise = lambda k: hashlib.sha256(str(k).encode()).hexdigest() * 40
    rows = [(k, f"u{k}", noise(k)) for k in range(200)] + [(5, "u5", noise(5))] * 50 + [(None, "n", noise(5))] * 3 + [(7, "s", "short")] * 4 + [(8, "long/" + "y" * 1_000_000, noise(8))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    rules = A.Rules(chunk_bytes=5_000, chunks_per_file=4)
    A.write(pages, str(tmp_path / "a"), rules)
    files = [f.read_bytes() for f in (tmp_path / "a").glob("part-*")]
    assert len(files) > 4 and all(len(f) < 40_000 for f in files)
    heads = [x[3][0] for f in files for x in A.salvage(f)]
    assert all(f.startswith(A.GZIP) and next(A.salvage(f))[3][0]["warc-type"] == "warcinfo" for f in files)
    ids = [h["warc-record-id"] for h in heads if h["warc-type"] != "warcinfo"]
    assert len(ids) == len(set(ids)) == len(rows)
    assert {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"} <= set(ids)
    got = A.read(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got if r.page_id == 5) == 50
    assert max(len(r.url or "") for r in got) > 1_000_000 and A.gaps(spark, str(tmp_path / "a")).count() == 0
