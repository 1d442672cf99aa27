"""Sharding by rendezvous hashing over weighted shards, in DataFrame operations only.

Each shard draws a number from the record's key and its own name; the smallest draw over its weight wins. A
further shard takes only the records that it wins, about its share, and none move between the others.

Slots number a shard's records without gaps, in hash order: records are counted by shard and hash range, the
counts are summed up in order, and a record's place within its range is added. Ranges hold about ``range_rows``
records at any size; equal records are counted before they are dealt, so none of them is a hot group, and their slots are
made in pieces of ``range_rows``.

Defined results: a null text has size 1 and the checksum of no bytes; rows without doc_id share one key, so one
shard; repeated rows get slots of their own; ties of two draws go to the lower shard, ties of two hashes by doc_id, size and
checksum; texts of any length count whole; an empty table gives no rows. Extra columns are never read, and ``assigned`` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rules:
    weights: tuple[float, ...] = (1.0,) * 8
    grown: float = 1.0  # weight of a further shard
    range_rows: int = 2048
    seed: int = 5


def draw(key: Column, shard: int, weight: float, seed: int) -> Column:
    """An exponential variate of rate ``weight``, the same for key and shard at all times."""
    whole = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11)
    return -F.ln((whole + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def shard(key: Column, weights: tuple[float, ...], seed: int) -> Column:
    """The winning shard; ties, which 53 bits all but exclude, go to the lower number."""
    return F.array_min(F.array(*(F.struct(draw(key, k, w, seed).alias("draw"), F.lit(k).alias("shard")) for k, w in enumerate(weights))))["shard"]


def assigned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with all its columns and __shard: a projection, without a shuffle."""
    return docs.withColumn("__shard", shard(F.col("doc_id"), rules.weights, rules.seed))


def slots(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    equal = ["doc_id", "size", "text_crc32"]
    # equal rows are one unit with a count
    units = rows.groupBy(equal).agg(F.count("*").alias("n"))
    units = units.withColumn("shard", shard(key, rules.weights, rules.seed)).withColumn("grown_shard", shard(key, (*rules.weights, rules.grown), rules.seed))
    units = C.materialize(units.withColumn("hash", F.xxhash64(*equal)), "units")
    ranges = max(1, -(-units.count() // (rules.range_rows * len(rules.weights))))
    units = units.withColumn("range", F.floor(F.pmod("hash", F.lit(1 << 62)) / F.lit((1 << 62) / ranges)).cast("bigint"))
    count = units.groupBy("shard", "range").agg(F.sum("n").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    count = count.select(F.col("shard").alias("__shard"), F.col("range").alias("__range"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("n").over(W.partitionBy("shard", "range").orderBy("hash", *equal).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    units = units.withColumn("__inside", inside)
    units = units.join(count, (F.col("shard") == F.col("__shard")) & (F.col("range") == F.col("__range"))).withColumn("__first", F.col("__before") + F.col("__inside"))
    # copies of one row in pieces, which are dealt anew where there are several
    step = F.lit(rules.range_rows).cast("bigint")
    last = F.col("__first") + F.col("n") - 1
    if units.where(F.col("n") > rules.range_rows).isEmpty():
        pieces = units.withColumn("__from", F.col("__first"))
    else:
        pieces = units.select("*", F.explode(F.sequence(F.col("__first"), last, step)).alias("__from")).repartition("hash", "__from")
    out = pieces.select("*", F.explode(F.sequence("__from", F.least(last, F.col("__from") + step - 1))).alias("slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
