"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Each document has a 60-bit hash of its id. Words are summed by source and hash bucket (12 bits); in the running
sums the bucket where a source's budget ends is found, and only that bucket is split further by the next 12
bits, until the threshold is one hash. Documents below their source's threshold are taken; no document is
sorted. Budgets beyond a source's size take all its documents once more, whole. An addition to the method: what the
threshold leaves open is filled by ``top_ups`` single documents, each the largest that fits, and of equal ones that of the
smallest hash.

Defined results: a null text has no words; null is a source of its own, the last; rows of one doc_id and source
are taken together, and each counts; rows without doc_id go by their text; a document without words is taken as its hash falls; none is
taken more than ``most`` times; texts of any length count whole; an empty table gives no rows. Extra columns are never read,
and ``mixed`` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rules:
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources by code point, repeating
    share: float = 1.5  # of all sizes
    most: float = 2.0  # of a source's own size
    top_ups: int = 3
    seed: str = "mix"


def sizes(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, source, size in words, hash."""
    key = F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), C.hash60(key, F.lit(":" + rules.seed)).alias("hash"))


def targets(own: DataFrame, rules: Rules, held: C.Scratch) -> DataFrame:
    """Per source: source_size and target. Sources may be as many as they like: ranges of them are summed up, and sums of ranges."""
    number = F.element_at(F.array(*map(F.lit, rules.weights)), (F.col("__rank") % len(rules.weights) + 1).cast("int"))
    source = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    source = C.summed_before(source, [F.asc_nulls_last("source")], {"__rank": F.lit(1)}, "ranks", held.put)
    source = source.withColumn("__weight", number.cast("double")).withColumn("__cap", F.col("source_size") * F.lit(rules.most))
    source = source.withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    # in order of cap per weight, sources are capped until the level that the rest of the budget gives is below their own
    source = C.summed_before(source, [F.asc("__ratio"), F.asc("__rank")], {"__caps": F.col("__cap"), "__weights": F.col("__weight")}, "levels", held.put)
    whole = source.agg(F.sum("source_size").alias("size"), F.sum("__weight").alias("weight"))
    level = (F.col("size") * F.lit(rules.share) - F.col("__caps")) / (F.col("weight") - F.col("__weights"))
    source = source.join(F.broadcast(whole)).withColumn("__level", level)  # one row
    line = source.agg(F.max(F.when(F.col("__ratio") >= F.col("__level"), F.col("__level"))).alias("__line"))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__line") * F.col("__weight"), F.col("__cap")))
    return source.join(F.broadcast(line)).select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def thresholds(units: DataFrame, source: DataFrame, rules: Rules, held: C.Scratch) -> DataFrame:
    """Per source: source_size, target, whole (times that all is taken), threshold, and the top-up hashes p0, p1, ..."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = source.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = held.put(state.select(F.col("source").alias("__source"), "source_size", "target", "whole", "left", F.lit(0).cast("bigint").alias("prefix"), F.lit(False).alias("ended")), "mix")
    same = F.col("source").eqNullSafe(F.col("__source"))
    names = ["__source", "source_size", "target", "whole"]
    for shift in range(BITS - STEP, -1, -STEP):
        # one histogram row for each source and bucket; those of ended sources have none
        inside = units.join(state, same & ~F.col("ended") & (F.shiftright("hash", shift + STEP) == F.col("prefix")))
        bars = inside.groupBy("__source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("unit").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = F.sum("n").over(W.partitionBy("__source").orderBy("bucket"))
        bars = bars.withColumn("until", run).withColumnRenamed("__source", "__s")
        over = bars.join(state, F.col("__s").eqNullSafe(F.col("__source"))).where("until > left")
        edge = over.groupBy("__s").agg(F.min_by(F.struct("bucket", (F.col("left") - (F.col("until") - F.col("n"))).alias("left"), "low", "high"), F.col("bucket")).alias("edge"))
        joined = state.join(edge, F.col("__s").eqNullSafe(F.col("__source")), "left")
        end = F.when(F.col("edge").isNull(), F.lit(1 << BITS)).otherwise(F.when(F.col("edge.low") == F.col("edge.high"), F.col("edge.low")))
        none = F.col("edge").isNull()
        # without an edge all of the prefix fits; that is so in the first step only, and then all documents fit
        fresh = joined.select(
            *names,
            F.when(F.col("ended") | none, F.col("left")).otherwise(F.col("edge.left")).alias("left"),
            F.when(F.col("ended"), F.col("prefix")).when(end.isNotNull(), end).otherwise(F.col("edge.bucket")).alias("prefix"),
            (F.col("ended") | end.isNotNull()).alias("ended"),
        )
        state = held.put(fresh, "mix")
        if state.where("not ended").isEmpty():
            break
    state = state.withColumnRenamed("prefix", "threshold").drop("ended")
    # what a threshold leaves open, including all of it where even the first document is too large
    for k in range(rules.top_ups):
        free = units.join(state, same).where((F.col("unit") > 0) & (F.col("unit") <= F.col("left")) & (F.col("hash") >= F.col("threshold")))
        for j in range(k):
            free = free.where(F.coalesce(F.col("hash") != F.col(f"p{j}"), F.lit(True)))
        pick = free.groupBy("source").agg(F.max(F.struct("unit", (-F.col("hash")).alias("hash"))).alias("pick")).withColumnRenamed("source", "__s")
        state = state.join(pick, F.col("__s").eqNullSafe(F.col("__source")), "left").drop("__s")
        state = state.withColumn(f"p{k}", -F.col("pick.hash")).withColumn("left", F.col("left") - F.coalesce("pick.unit", F.lit(0))).drop("pick")
        state = held.put(state, "mix")
    return state


def decided(own: DataFrame, rules: Rules) -> DataFrame:
    """own: a table of ``sizes``. Per source what ``thresholds`` gives; the tables that led to it are removed."""
    with C.Scratch(own.sparkSession) as held:
        units = held.put(own.groupBy("source", "hash").agg(F.sum("size").alias("unit")), "units")
        return C.materialize(thresholds(units, held.put(targets(own, rules, held), "targets"), rules, held), "thresholds")


def taken_times(rules: Rules) -> Column:
    """How often a document is taken, where its row has its source's thresholds."""
    extra = F.col("hash") < F.col("threshold")
    for k in range(rules.top_ups):
        extra = extra | F.coalesce(F.col("hash") == F.col(f"p{k}"), F.lit(False))
    return F.least(F.col("whole") + extra.cast("bigint"), F.lit(int(rules.most)).cast("bigint"))


def plan(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: doc_id, source, size, hash, source_size, target, times, taken."""
    own = C.materialize(sizes(docs, rules), "sizes")
    state = decided(own, rules)
    rows = own.join(state, F.col("source").eqNullSafe(F.col("__source")))
    return rows.select("doc_id", "source", "size", "hash", "source_size", "target", taken_times(rules).alias("times")).withColumn("taken", F.col("size") * F.col("times"))


def mixed(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with all their columns."""
    with C.Scratch(docs.sparkSession) as held:
        state = decided(held.put(sizes(docs, rules), "sizes"), rules)
    state = state.select(F.col("__source"), "whole", "threshold", *(f"p{k}" for k in range(rules.top_ups)))
    key = F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "source", C.hash60(key, F.lit(":" + rules.seed)).alias("hash"))
    rows = rows.join(state, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__times", taken_times(rules)).where("__times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))).select("__row.*")


#: The same in SQL: documents in hash order up to the budget, then the top-ups.
ORACLE = r"""
WITH own AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '') || ':mix'), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS r, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE r WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s1),
s3 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s2),
s4 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
       FROM s3 WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, max(CASE WHEN ratio >= level THEN level END) OVER () AS line FROM s4),
s6 AS (SELECT source, source_size, greatest(least(cap, coalesce(line * w, cap)), 0.0::DOUBLE) AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s6),
s8 AS (SELECT *, target - whole * source_size AS room FROM s7),
units AS (SELECT source, h, sum(size)::BIGINT AS unit FROM own GROUP BY source, h),
u AS (SELECT units.*, room, sum(unit) OVER (PARTITION BY units.source ORDER BY h) AS until FROM units JOIN s8 ON units.source IS NOT DISTINCT FROM s8.source),
t0 AS (SELECT source, h, unit, max(CASE WHEN until <= room THEN until ELSE 0 END) OVER (PARTITION BY source) AS used, room, until <= room AS own FROM u),
g0 AS (SELECT source, any_value(room) - any_value(used) AS room FROM t0 GROUP BY source),
p0 AS (SELECT g0.source, arg_max(h, [unit, -h]) AS p, max(unit) AS unit FROM g0 JOIN t0 ON g0.source IS NOT DISTINCT FROM t0.source WHERE NOT own AND unit > 0 AND unit <= g0.room GROUP BY g0.source),
g1 AS (SELECT g0.source, g0.room - coalesce(p0.unit, 0) AS room, coalesce([p], []) AS picks FROM g0 LEFT JOIN p0 ON g0.source IS NOT DISTINCT FROM p0.source),
p1 AS (SELECT g1.source, arg_max(h, [unit, -h]) AS p, max(unit) AS unit FROM g1 JOIN t0 ON g1.source IS NOT DISTINCT FROM t0.source WHERE NOT own AND unit > 0 AND unit <= g1.room AND NOT list_contains(picks, h) GROUP BY g1.source),
g2 AS (SELECT g1.source, g1.room - coalesce(p1.unit, 0) AS room, list_concat(picks, [p]) AS picks FROM g1 LEFT JOIN p1 ON g1.source IS NOT DISTINCT FROM p1.source),
p2 AS (SELECT g2.source, arg_max(h, [unit, -h]) AS p, max(unit) AS unit FROM g2 JOIN t0 ON g2.source IS NOT DISTINCT FROM t0.source WHERE NOT own AND unit > 0 AND unit <= g2.room AND NOT coalesce(list_contains(picks, h), false) GROUP BY g2.source),
g3 AS (SELECT g2.source, list_concat(picks, [p]) AS picks FROM g2 LEFT JOIN p2 ON g2.source IS NOT DISTINCT FROM p2.source)
SELECT own.doc_id, own.size, s8.source_size, s8.target,
       (own.size * (s8.whole + CASE WHEN t0.own OR coalesce(list_contains(g3.picks, own.h), false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM own JOIN s8 ON own.source IS NOT DISTINCT FROM s8.source JOIN t0 ON own.source IS NOT DISTINCT FROM t0.source AND own.h = t0.h
JOIN g3 ON own.source IS NOT DISTINCT FROM g3.source
"""
