"""Registered queries over whole tables, and the same in plain SQL.

Clouds are users' events (``ev``: time and value, scaled to 0..10000) or suppliers' order lines (``li``); queries are
the same clouds with every point moved by up to 80 on either axis (``far``; up to 5 for ``li``), or with a tenth of the points somewhere
else (``off``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cell, floor_l2, l2
from .operators import cellsets, evaluate, fingerprints, intersect, knn, postings, voting
from .params import FingerprintParams, GridParams
from .plans import CloudIndex
from .sources import clouds_from_events, clouds_from_lineitem, disturbed, jittered, load_postings, read_clouds_csv, save_postings, write_clouds_csv
from .sources.clouds import within
from .storage import shared_path
from .streaming import append_postings, read_postings

GRID = GridParams(10_000, 100)
ODD_GRID = GridParams(10_000, 7)
FINE_GRID = GridParams(10_000, 10)
PRINTS = FingerprintParams(delta_x=2000, delta_y=2000)
AT = [1, 5, 10]
NEAR, FAR = 5.0, 80.0
CENTRES = 16


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return clouds_from_events(spark.read.parquet(f"{sf}/events.parquet"))


def li(spark: SparkSession, sf: str) -> DataFrame:
    return clouds_from_lineitem(spark.read.parquet(f"{sf}/lineitem.parquet"))


def off(spark: SparkSession, sf: str) -> DataFrame:
    return disturbed(ev(spark, sf), 10)


def far(spark: SparkSession, sf: str) -> DataFrame:
    return jittered(ev(spark, sf), FAR)


# ---------------------------------------------------------------- SQL parts
_MOVED = "greatest(0.0::DOUBLE, least({c} + ((point_id * {f}) % 201 - 100) * {r}::DOUBLE / 100.0::DOUBLE, 9999.0::DOUBLE))"
_EV = """ev AS (SELECT user_id::BIGINT AS cloud_id, event_id::BIGINT AS point_id,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 2592000000000.0::DOUBLE * 10000.0::DOUBLE AS x, least(value * 20.0::DOUBLE, 10000.0::DOUBLE) AS y FROM events)"""
_LI = """li AS (SELECT l_suppkey::BIGINT AS cloud_id, l_orderkey::BIGINT * 10 + l_linenumber AS point_id, least(l_extendedprice::DOUBLE / 10.5::DOUBLE, 10000.0::DOUBLE) AS x,
  ((l_partkey::BIGINT * 7919 + l_orderkey::BIGINT * 104729) % 1000003) * 10000.0::DOUBLE / 1000003.0::DOUBLE AS y FROM lineitem)"""


def _queries(reach: float, name: str = "q", table: str = "ev") -> str:
    x, y = (_MOVED.format(c=c, f=f, r=reach) for c, f in (("x", 37), ("y", 53)))
    return f"{name} AS (SELECT cloud_id AS query_id, {x} AS x, {y} AS y FROM {table})"


_DISTURBED = "q AS (SELECT cloud_id AS query_id, CASE WHEN (point_id * 37) % 100 < 10 THEN 10000.0::DOUBLE - x ELSE x END AS x, CASE WHEN (point_id * 37) % 100 < 10 THEN 10000.0::DOUBLE - y ELSE y END AS y FROM ev)"


def _cell(grid: GridParams) -> str:
    return f"(floor(x / {grid.delta}.0::DOUBLE)::BIGINT + {grid.stride} * floor(y / {grid.delta}.0::DOUBLE)::BIGINT)"


def _counted(name: str, table: str, key: str, grid: GridParams) -> str:
    return f"{name} AS (SELECT {_cell(grid)} AS cell, {key}, count(*) AS cnt FROM {table} GROUP BY ALL)"


def _votes(grid: GridParams, reach: float, kind: str = "bag", table: str = "ev") -> str:
    """CTEs up to votes."""
    index = {"bag": "i", "set": "(SELECT cell, cloud_id, 1 AS cnt FROM i)", "literal": "(SELECT cell, cloud_id, 1 AS cnt FROM i QUALIFY cloud_id < max(cloud_id) OVER (PARTITION BY cell))"}[kind]
    return f"""WITH {_EV if table == "ev" else _LI}, {_queries(reach, "q", table)}, {_counted("i", table, "cloud_id", grid)}, {_counted("qi", "q", "query_id", grid)},
votes AS (SELECT query_id, cloud_id, sum(qi.cnt * p.cnt)::BIGINT AS votes FROM qi JOIN {index} p ON qi.cell = p.cell GROUP BY ALL)"""


def _top(k: int) -> str:
    return f"ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, cloud_id) AS rank, cloud_id, votes FROM votes QUALIFY rank <= {k})"


def _recall(answered: bool = False) -> str:
    base = "ranked" if answered else "q"
    return "SELECT k::BIGINT AS k, (SELECT count(*) FROM ranked WHERE cloud_id = query_id AND rank <= k) / (SELECT count(DISTINCT query_id) FROM " + base + f")::DOUBLE AS recall FROM (SELECT unnest({AT}) AS k)"


def _neighbours(k: int, metric: str, cell: GridParams | None = None, reach: float = FAR) -> str:
    """CTEs up to n: the nearest k points of each distinct query point."""
    d2 = "(a.x - e.x) * (a.x - e.x) + (a.y - e.y) * (a.y - e.y)"
    d = {"l2": d2, "floor_l2": f"floor(sqrt({d2}))::BIGINT", "plain": f"sqrt({d2})", "l1": "abs(a.x - e.x) + abs(a.y - e.y)", "floor_l1": "(abs(floor(a.x) - floor(e.x)) + abs(floor(a.y) - floor(e.y)))::BIGINT"}[metric]
    on = "true"
    if cell is not None:
        own = lambda t: _cell(cell).replace("(x /", f"({t}.x /").replace("(y /", f"({t}.y /")
        on = f"{own('a')} = {own('e')}"
    return f"""WITH {_EV}, {_queries(reach)}, a AS (SELECT query_id, x, y, count(*) AS weight FROM q GROUP BY ALL),
m AS (SELECT a.query_id, a.x AS qx, a.y AS qy, a.weight, min({{d: {d}, c: e.cloud_id, x: e.x, y: e.y}}, {k}) AS best FROM a JOIN ev e ON {on} GROUP BY ALL),
n AS (SELECT query_id, qx, qy, weight, unnest(best) AS b FROM m), votes AS (SELECT query_id, b.c AS cloud_id, sum(weight)::BIGINT AS votes FROM n GROUP BY ALL)"""


_NEIGHBOUR_ROWS = "SELECT query_id, qx, qy, b.c AS cloud_id, b.d AS distance, count(*)::BIGINT AS taken FROM n GROUP BY ALL"


def _lattice(table: str, key: str) -> str:
    return f"(SELECT {key}, floor(x / 1.0::DOUBLE)::BIGINT AS x, floor(y / 1.0::DOUBLE)::BIGINT AS y FROM {table})"


def _zone(table: str, key: str, zone: str) -> str:
    """CTEs o (lattice points) and z (pairs of a distinct anchor with each point of its zone)."""
    less = "<" if zone == "open" else "<="
    return f"""o AS {_lattice(table, key)}, an AS (SELECT {key}, x AS ax, y AS ay, count(*) AS acnt FROM o GROUP BY ALL),
z AS (SELECT an.{key}, ax, ay, acnt, o.x AS px, o.y AS py FROM an JOIN o ON an.{key} = o.{key} AND ay >= 1000 AND 0 {less} o.x - ax AND o.x - ax {less} 2000 AND abs(o.y - ay) {less} 1000)"""


def _prints(table: str, key: str, zone: str, name: str) -> str:
    own = _zone(table, key, zone).replace("o AS", f"o{name} AS").replace("an AS", f"an{name} AS").replace("z AS", f"z{name} AS").replace("FROM o ", f"FROM o{name} ").replace("FROM an JOIN o ON an.", f"FROM an{name} an JOIN o{name} o ON an.")
    return f"""{own}, l{name} AS (SELECT *, row_number() OVER (PARTITION BY {key}, ax, ay ORDER BY px, py) AS r FROM z{name}),
{name} AS (SELECT {key}, ay AS y1, py AS y2, px - ax AS dx, sum(acnt)::BIGINT AS cnt FROM l{name} WHERE r <= 10 GROUP BY ALL)"""


_PRINT_VOTES = f"""WITH {_EV}, {_DISTURBED}, {_prints("ev", "cloud_id", "closed", "fi")}, {_prints("q", "query_id", "open", "fq")},
votes AS (SELECT query_id, cloud_id, sum(fq.cnt * fi.cnt)::BIGINT AS votes FROM fq JOIN fi USING (y1, y2, dx) GROUP BY ALL)"""

_SETS = f"""WITH {_EV}, {_queries(FAR)}, i AS (SELECT DISTINCT {_cell(GRID)} AS cell, cloud_id FROM ev), qi AS (SELECT DISTINCT {_cell(GRID)} AS cell, query_id FROM q),
ni AS (SELECT cloud_id, count(*) AS n FROM i GROUP BY ALL), nq AS (SELECT query_id, count(*) AS qn FROM qi GROUP BY ALL),
s AS (SELECT query_id, cloud_id, count(*) AS shared FROM qi JOIN i USING (cell) GROUP BY ALL),
every AS (SELECT nq.query_id, ni.cloud_id, coalesce(shared, 0) AS shared, qn, n FROM nq CROSS JOIN ni LEFT JOIN s ON s.query_id = nq.query_id AND s.cloud_id = ni.cloud_id),
d AS (SELECT *, round({{d}}, 9) AS distance FROM every)"""
_DISTANCES = {
    "angular": "CASE WHEN shared / (sqrt(qn) * sqrt(n)) >= 1 THEN 0.0::DOUBLE ELSE acos(shared / (sqrt(qn) * sqrt(n))) END",
    "hamming": "(qn + n - 2 * shared)::DOUBLE",
    "jaccard": "1.0::DOUBLE - shared / (qn + n - shared)",
    "dice": "1.0::DOUBLE - 2 * shared / (qn + n)",
}


def _set_top(metric: str, k: int) -> str:
    return _SETS.replace("{d}", _DISTANCES[metric]) + f", ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, cloud_id) AS rank, cloud_id, distance FROM d QUALIFY rank <= {k})"


_BOXES = f"""WITH {_EV}, {_queries(FAR)}, h AS (SELECT query_id, e.cloud_id, count(*)::BIGINT AS hits FROM q JOIN ev e ON e.x BETWEEN q.x - 50.0::DOUBLE AND q.x + 50.0::DOUBLE AND e.y BETWEEN q.y - 50.0::DOUBLE AND q.y + 50.0::DOUBLE GROUP BY ALL),
b AS (SELECT query_id, cloud_id, hits, cloud_size, hits / cloud_size::DOUBLE AS support FROM h JOIN (SELECT cloud_id, count(*)::BIGINT AS cloud_size FROM ev GROUP BY ALL) USING (cloud_id))"""
_CENTRES = f"""WITH {_EV}, c AS (SELECT row_number() OVER (ORDER BY point_id) - 1 AS centre, x, y FROM ev ORDER BY point_id LIMIT {CENTRES}),
near AS (SELECT e.cloud_id, e.point_id, min({{d: (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y), k: centre}}) AS b FROM ev e CROSS JOIN c GROUP BY ALL),
assigned AS (SELECT cloud_id, point_id, b.k::BIGINT AS centre, sqrt(b.d) AS distance FROM near)"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- sources, cells
@query(f"WITH {_EV} SELECT cloud_id, count(*)::BIGINT AS cloud_size FROM ev GROUP BY ALL")
def cloud_sizes(spark, sf):
    return postings.cloud_sizes(ev(spark, sf))


@query(f"WITH {_EV} SELECT * FROM ev WHERE x BETWEEN 1000 AND 9000 AND y BETWEEN 1000 AND 9000")
def bounds_filter(spark, sf):
    return ev(spark, sf).where(within((1000, 9000)))


@query(f"WITH {_EV} SELECT cloud_id, point_id, {_cell(GRID)} AS cell FROM ev")
def grid_cells(spark, sf):
    return ev(spark, sf).select("cloud_id", "point_id", cell(GRID).alias("cell"))


@query(f"WITH {_EV} SELECT cloud_id, point_id, {_cell(ODD_GRID)} AS cell FROM ev")
def grid_cells_nondivisible(spark, sf):
    return ev(spark, sf).select("cloud_id", "point_id", cell(ODD_GRID).alias("cell"))


@query(f"WITH {_EV} SELECT cloud_id, x, y, count(*)::BIGINT AS cnt FROM {_lattice('ev', 'cloud_id')} GROUP BY ALL")
def lattice_points(spark, sf):
    return fingerprints.on_lattice(ev(spark, sf), PRINTS)


@query(f"WITH {_EV} SELECT cloud_id, x, y FROM ev WHERE x BETWEEN 0 AND 10000 AND y BETWEEN 0 AND 10000")
def csv_round_trip(spark, sf):
    path = shared_path(spark, "clouds-csv")
    write_clouds_csv(ev(spark, sf), path)
    return read_clouds_csv(spark, path).drop("point_id")


# ---------------------------------------------------------------- votes by cell
@query(f"WITH {_EV}, {_counted('i', 'ev', 'cloud_id', GRID)} SELECT cell, cloud_id, cnt::BIGINT AS cnt FROM i")
def igi_postings(spark, sf):
    return postings.bag_postings(ev(spark, sf), GRID)


@query(f"WITH {_EV} SELECT cell, string_agg(cloud_id::VARCHAR, ',' ORDER BY cloud_id) AS ids FROM (SELECT {_cell(GRID)} AS cell, cloud_id FROM ev) GROUP BY ALL")
def igi_posting_lists(spark, sf):
    return postings.posting_lists(postings.bag_postings(ev(spark, sf), GRID)).select("cell", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {_EV}, {_counted('i', 'ev', 'cloud_id', GRID)} SELECT cell, cloud_id, cnt::BIGINT AS cnt FROM i")
def igi_incremental_add(spark, sf):
    points = ev(spark, sf)
    return CloudIndex("grid", points.where("x < 5000"), GRID).add(points.where("x >= 5000")).table


@query(_votes(GRID, FAR) + " SELECT * FROM votes")
def igi_votes(spark, sf):
    return voting.grid_votes(postings.bag_postings(ev(spark, sf), GRID), far(spark, sf), GRID)


@query(f"{_votes(GRID, FAR)}, {_top(5)} SELECT * FROM ranked")
def igi_knn_top5(spark, sf):
    return CloudIndex("grid", ev(spark, sf), GRID).knn(far(spark, sf), 5)


@query(f"{_votes(FINE_GRID, NEAR, table='li')}, {_top(5)} SELECT * FROM ranked")
def igi_knn_lineitem(spark, sf):
    points = li(spark, sf)
    return CloudIndex("grid", points, FINE_GRID).knn(jittered(points, NEAR), 5)


@query(f"{_votes(GRID, FAR)}, {_top(1)} SELECT query_id, cloud_id, votes FROM ranked")
def igi_knn_top1_mode(spark, sf):
    return voting.top_voted(postings.bag_postings(ev(spark, sf), GRID), far(spark, sf), GRID, 1).drop("rank")


@query(f"{_votes(GRID, FAR)}, {_top(10)} {_recall()}")
def igi_recall(spark, sf):
    queries = far(spark, sf)
    return evaluate.recall(CloudIndex("grid", ev(spark, sf), GRID).knn(queries, 10), queries, AT, 10)


@query(f"{_votes(FINE_GRID, FAR)}, {_top(10)} {_recall(True)}")
def igi_recall_answered(spark, sf):
    queries = far(spark, sf)
    return evaluate.recall(CloudIndex("grid", ev(spark, sf), FINE_GRID).knn(queries, 10), queries, AT, 10, "answered")


@query(f"WITH {_EV} SELECT DISTINCT {_cell(GRID)} AS cell, cloud_id FROM ev")
def succinct_postings(spark, sf):
    return postings.set_postings(ev(spark, sf), GRID)


_ONES = f"WITH {_EV} SELECT {_cell(GRID)} AS cell, count(DISTINCT cloud_id)::BIGINT AS ones FROM ev GROUP BY ALL"


@query(_ONES)
def succinct_ones_per_cell(spark, sf):
    return postings.ones_per_cell(postings.set_postings(ev(spark, sf), GRID))


@query(_ONES)
def bitmap_ones(spark, sf):
    return postings.bitmap_ones(postings.bitmaps(postings.set_postings(ev(spark, sf), GRID)))


@query(f"{_votes(GRID, FAR, 'set')}, {_top(5)} SELECT * FROM ranked")
def succinct_knn_top5(spark, sf):
    return CloudIndex("succinct", ev(spark, sf), GRID).knn(far(spark, sf), 5)


@query(f"{_votes(GRID, FAR, 'literal')}, {_top(5)} SELECT * FROM ranked")
def succinct_knn_literal(spark, sf):
    return CloudIndex("succinct", ev(spark, sf), GRID, literal_last_skip=True).knn(far(spark, sf), 5)


@query(f"{_votes(GRID, FAR, 'set')}, {_top(10)} {_recall()}")
def succinct_recall(spark, sf):
    queries = far(spark, sf)
    return evaluate.recall(CloudIndex("succinct", ev(spark, sf), GRID).knn(queries, 10), queries, AT, 10)


@query(f"WITH {_EV}, {_counted('i', 'ev', 'cloud_id', GRID)} SELECT cell, cloud_id, cnt::BIGINT AS cnt FROM i")
def postings_orc_roundtrip(spark, sf):
    path = shared_path(spark, "postings-orc")
    save_postings(postings.bag_postings(ev(spark, sf), GRID), path, "orc")
    return load_postings(spark, path, "orc")


@query(f"WITH {_EV}, {_counted('i', 'ev', 'cloud_id', GRID)} SELECT cell, cloud_id, cnt::BIGINT AS cnt FROM i")
def streaming_postings(spark, sf):
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    points = clouds_from_events(spark.readStream.schema(schema).parquet(f"{source}*"))  # a stream reads folders or patterns
    path = shared_path(spark, "postings-stream")
    append_postings(points, path, shared_path(spark, "stream-checkpoint"), GRID).awaitTermination()
    return read_postings(spark, path)


# ---------------------------------------------------------------- neighbours
def _neighbour_rows(found: DataFrame) -> DataFrame:
    return found.drop("weight")


@query(_neighbours(3, "l2", GRID) + " " + _NEIGHBOUR_ROWS)
def cell_knn_l2(spark, sf):
    return _neighbour_rows(knn.cell_knn(ev(spark, sf), far(spark, sf), GRID, 3, merged=True))


@query(_neighbours(3, "plain", GRID) + " " + _NEIGHBOUR_ROWS)
def cell_knn_metric(spark, sf):
    return _neighbour_rows(knn.cell_knn(ev(spark, sf), far(spark, sf), GRID, 3, l2, merged=True))


@query(f"{_neighbours(3, 'l2', GRID)}, {_top(5)} SELECT * FROM ranked")
def igirtree_knn_top5(spark, sf):
    return CloudIndex("grid_rtree", ev(spark, sf), GRID, internal_k=3).knn(far(spark, sf), 5)


@query(f"{_neighbours(3, 'floor_l2', GRID)}, {_top(5)} SELECT * FROM ranked")
def igivpt_knn_top5(spark, sf):
    return CloudIndex("grid_vpt", ev(spark, sf), GRID, internal_k=3, metric=floor_l2).knn(far(spark, sf), 5)


@query(_neighbours(3, "l2") + " " + _NEIGHBOUR_ROWS)
def point_knn_l2(spark, sf):
    return _neighbour_rows(knn.point_knn(ev(spark, sf), far(spark, sf), 3, merged=True))


@query(_neighbours(3, "floor_l2") + " " + _NEIGHBOUR_ROWS)
def point_knn_floor_l2(spark, sf):
    return _neighbour_rows(knn.point_knn(ev(spark, sf), far(spark, sf), 3, "floor_l2", merged=True))


@query(f"{_neighbours(3, 'l2')}, {_top(5)} SELECT * FROM ranked")
def rtree_knn_top5(spark, sf):
    return CloudIndex("rtree", ev(spark, sf), internal_k=3).knn(far(spark, sf), 5)


@query(f"{_neighbours(3, 'l2')}, {_top(5)} SELECT * FROM ranked")
def vpt_knn_top5(spark, sf):
    return CloudIndex("vpt", ev(spark, sf), internal_k=3).knn(far(spark, sf), 5)


@query(f"{_neighbours(1, 'floor_l2')}, {_top(5)} SELECT * FROM ranked")
def bkt_knn_top5(spark, sf):
    return CloudIndex("bkt", ev(spark, sf), internal_k=1).knn(far(spark, sf), 5)


@query(f"{_neighbours(3, 'l2')}, {_top(5)} SELECT * FROM ranked")
def revlc_knn_top5(spark, sf):
    return CloudIndex("revlc", ev(spark, sf), internal_k=3).knn(far(spark, sf), 5)


def l1(qx, qy, x, y):
    return F.abs(qx - x) + F.abs(qy - y)


def floor_l1(qx, qy, x, y):
    return (F.abs(F.floor(qx) - F.floor(x)) + F.abs(F.floor(qy) - F.floor(y))).cast("bigint")


@query(f"{_neighbours(3, 'l1')}, {_top(5)} SELECT * FROM ranked")
def vpt_knn_l1(spark, sf):
    return CloudIndex("vpt", ev(spark, sf), internal_k=3, metric=l1).knn(far(spark, sf), 5)


@query(f"{_neighbours(3, 'l1')}, {_top(5)} SELECT * FROM ranked")
def revlc_knn_l1(spark, sf):
    return CloudIndex("revlc", ev(spark, sf), internal_k=3, metric=l1).knn(far(spark, sf), 5)


@query(f"{_neighbours(1, 'floor_l1')}, {_top(5)} SELECT * FROM ranked")
def bkt_knn_custom(spark, sf):
    return CloudIndex("bkt", ev(spark, sf), internal_k=1, metric=floor_l1).knn(far(spark, sf), 5)


@query(_neighbours(3, "l2") + " " + _NEIGHBOUR_ROWS)
def point_knn_clusters(spark, sf):
    return _neighbour_rows(knn.point_knn(ev(spark, sf), far(spark, sf), 3, strategy="clusters", merged=True))


@query(f"{_neighbours(1, 'l2')}, {_top(10)} {_recall()}")
def rtree_recall(spark, sf):
    queries = far(spark, sf)
    return evaluate.recall(CloudIndex("rtree", ev(spark, sf)).knn(queries, 10), queries, AT, 10)


def _centres(points: DataFrame) -> list[tuple[float, float]]:
    return [(r.x, r.y) for r in points.orderBy("point_id").limit(CENTRES).collect()]


@query(_CENTRES + " SELECT cloud_id, point_id, centre, distance FROM assigned")
def center_assignment(spark, sf):
    points = ev(spark, sf)
    return knn.assign_centres(points, _centres(points)).select("cloud_id", "point_id", "centre", "distance")


@query(_CENTRES + " SELECT centre, max(distance) AS radius, count(*)::BIGINT AS members FROM assigned GROUP BY ALL")
def cluster_radii(spark, sf):
    points = ev(spark, sf)
    return knn.covering_radii(knn.assign_centres(points, _centres(points)))


# ---------------------------------------------------------------- boxes
@query(_BOXES + " SELECT * FROM b")
def box_support(spark, sf):
    return intersect.box_support(ev(spark, sf), far(spark, sf), 100)


@query(_BOXES + " SELECT * FROM b WHERE support > 0.05")
def box_support_eps(spark, sf):
    return CloudIndex("rtree", ev(spark, sf)).intersection(far(spark, sf), 100, 0.05, ordered=False)


# ---------------------------------------------------------------- fingerprints
_PAIRS = " SELECT cloud_id, ax, ay, acnt::BIGINT AS acnt, px, py, count(*)::BIGINT AS pcnt FROM z GROUP BY ALL"


@query(f"WITH {_EV}, {_zone('ev', 'cloud_id', 'open')}{_PAIRS}")
def zone_pairs_open(spark, sf):
    return fingerprints.zone_pairs(ev(spark, sf), PRINTS, "open")


@query(f"WITH {_EV}, {_zone('ev', 'cloud_id', 'closed')}{_PAIRS}")
def zone_pairs_closed(spark, sf):
    return fingerprints.zone_pairs(ev(spark, sf), PRINTS, "closed")


@query(f"WITH {_EV}, {_prints('ev', 'cloud_id', 'closed', 'f')} SELECT * FROM f")
def fingerprints_index(spark, sf):
    return fingerprints.fingerprints(ev(spark, sf), PRINTS, "closed")


@query(f"WITH {_EV}, {_DISTURBED}, {_prints('q', 'query_id', 'open', 'f')} SELECT * FROM f")
def fingerprints_query(spark, sf):
    return fingerprints.fingerprints(off(spark, sf), PRINTS, "open", "query_id")


@query(f"{_PRINT_VOTES}, {_top(5)} SELECT * FROM ranked")
def fingerprint_knn_top5(spark, sf):
    return CloudIndex("fingerprint", ev(spark, sf), prints=PRINTS).knn(off(spark, sf), 5)


@query(f"{_PRINT_VOTES}, {_top(10)} {_recall()}")
def fingerprint_recall(spark, sf):
    queries = off(spark, sf)
    return evaluate.recall(CloudIndex("fingerprint", ev(spark, sf), prints=PRINTS).knn(queries, 10), queries, AT, 10)


# ---------------------------------------------------------------- cell sets
@query(f"WITH {_EV} SELECT cloud_id, string_agg(cell::VARCHAR, ',' ORDER BY cell) AS cells, count(*)::BIGINT AS n FROM (SELECT DISTINCT cloud_id, {_cell(GRID)} AS cell FROM ev) GROUP BY ALL")
def cell_sets(spark, sf):
    return cellsets.cell_sets(ev(spark, sf), GRID).select("cloud_id", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"), "n")


@query(_SETS.replace("{d}", "0.0::DOUBLE") + " SELECT query_id, cloud_id, shared::BIGINT AS shared FROM s")
def set_inner_product(spark, sf):
    return cellsets.inner_products(postings.set_postings(ev(spark, sf), GRID), far(spark, sf).select(cell(GRID).alias("cell"), "query_id"))


@query(_set_top("angular", 5) + " SELECT * FROM ranked")
def set_knn_angular(spark, sf):
    return CloudIndex("set_angular", ev(spark, sf), GRID).knn(far(spark, sf), 5)


@query(_set_top("hamming", 5) + " SELECT * FROM ranked")
def set_knn_hamming(spark, sf):
    return CloudIndex("set_hamming", ev(spark, sf), GRID).knn(far(spark, sf), 5)


@query(_set_top("jaccard", 5) + " SELECT * FROM ranked")
def set_knn_jaccard(spark, sf):
    return CloudIndex("set_jaccard", ev(spark, sf), GRID).knn(far(spark, sf), 5)


@query(_SETS.replace("{d}", _DISTANCES["angular"]) + " SELECT query_id, count(*) FILTER (distance <= 1.2)::BIGINT AS near FROM d GROUP BY ALL")
def set_near_dup_count(spark, sf):
    return cellsets.near_pairs(ev(spark, sf), far(spark, sf), GRID, "angular", 1.2)


@query(_SETS.replace("{d}", _DISTANCES["hamming"]) + " SELECT query_id, count(*) FILTER (distance <= 130)::BIGINT AS near FROM d GROUP BY ALL")
def set_near_dup_hamming(spark, sf):
    return cellsets.near_pairs(ev(spark, sf), far(spark, sf), GRID, "hamming", 130.0)


@query(_set_top("dice", 5) + " SELECT * FROM ranked")
def set_knn_dice(spark, sf):
    return CloudIndex("set", ev(spark, sf), GRID, metric=lambda shared, a, b: F.lit(1.0) - 2 * shared / (a + b), disjoint="alike").knn(far(spark, sf), 5)


@query(f"{_set_top('angular', 20)} SELECT k::BIGINT AS k, (SELECT count(*) FROM ranked WHERE cloud_id = query_id AND rank <= k) / (SELECT count(DISTINCT query_id) FROM q)::DOUBLE AS recall FROM (SELECT unnest([5, 10, 20]) AS k)")
def set_recall(spark, sf):
    queries = far(spark, sf)
    return evaluate.recall(CloudIndex("set_angular", ev(spark, sf), GRID).knn(queries, 20), queries, [5, 10, 20], 20)


@query(f"WITH {_EV}, t AS (SELECT count(*)::DOUBLE AS s FROM ev GROUP BY cloud_id) SELECT round(avg(s), 9) AS average, round(coalesce(stddev_samp(s), 0), 9) AS sd, min(s) AS min, max(s) AS max FROM t")
def timing_stats(spark, sf):
    stats = evaluate.time_stats(postings.cloud_sizes(ev(spark, sf)), "cloud_size")
    return stats.select(F.round("average", 9).alias("average"), F.round("sd", 9).alias("sd"), "min", "max")
