"""Weighted rendezvous sharding of stable record keys, in built-in functions only.

Every key draws one score for each shard from a hash of key and shard; the highest score wins. A shard's
score does not depend on the other shards, so one shard more takes keys only into itself.

A null key is a key like any other. Rows that are equal in key and content share a shard and get slots
of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_offsets, written

#: Slots are counted within hash ranges of each shard of about so many rows, then across the ranges.
RANGE_ROWS = 100_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that a key belongs to; shards draw keys in proportion to their weights.

    The score -weight / ln(u), with u uniform in (0, 1), is the usual one for weighted rendezvous hashing. u is half a step off
    the 52 upper bits of the hash, so it is never 0 or 1, and the logarithm never 0.
    Ties go to the higher shard.
    """
    scores = [
        F.struct(
            (F.lit(-float(weight)) / F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12) + F.lit(0.5)) / F.lit(float(1 << 52)))).alias("score"),
            F.lit(shard).alias("shard"),
        )
        for shard, weight in enumerate(weights)
    ]
    return F.array_max(F.array(*scores))["shard"]


def assign_shards(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """df with the shard of each row's key; no shuffle."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


def with_slots(rows: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """rows, numbered from 0 without gaps within each shard, in the order of a hash of their columns.

    Equal rows are counted before the shuffle and numbered after it, so copies of one row don't meet in a
    task. A shard's rows are numbered in hash ranges, as many as the rows need; a range's first number is the sum of the
    earlier ranges' counts. The distinct rows are written once, as both steps read them.
    """
    names = rows.columns
    at, copies, before = "__range", "__copies", "__before"
    distinct = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(copies))
    distinct = written(distinct, "slots")
    distinct = distinct.withColumn(at, F.pmod(F.xxhash64(*names), F.lit(16 + distinct.count() // RANGE_ROWS)).cast("int"))
    offsets = prefix_offsets(distinct.groupBy(shard, at).agg(F.sum(copies).alias("__n")), [shard], at, "__n").select(F.col(shard).alias("__shard"), F.col(at).alias("__at"), F.col("offset").alias("__offset"))
    earlier = Window.partitionBy(shard, at).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    numbered = distinct.withColumn(before, F.coalesce(F.sum(copies).over(earlier), F.lit(0)))
    numbered = numbered.join(offsets, (F.col(shard) == F.col("__shard")) & (F.col(at) == F.col("__at")))
    first = F.col("__offset") + F.col(before)
    return numbered.select(*names, F.explode(F.sequence(first, first + F.col(copies) - 1)).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every document, with its size, checksum, and shard if there were one shard more."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        rendezvous(F.col(key), [1.0] * shards).alias("shard"),
        rendezvous(F.col(key), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return with_slots(rows, "shard").withColumn("law", F.lit("key"))


def write_shards(df: DataFrame, path: str, key: str, weights: list[float], files_per_shard: int = 8) -> None:
    """Write df as Parquet, a folder for each shard; a shard's rows are dealt to several files by their content."""
    columns = df.columns
    sharded = assign_shards(df, key, weights, "shard").withColumn("__file", F.pmod(F.xxhash64(*columns), F.lit(files_per_shard)))
    sharded.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
