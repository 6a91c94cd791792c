"""Connected components of any graph by distributed union-find (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (large star) or smaller (small star) neighbours to the smallest around it.

    The smallest are written before they meet the pairs again: a node with very many neighbours is then a
    skewed join, which Spark splits, and not one task's work.
    """
    if large:
        sides = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
    else:
        sides = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    least = written(least, "least", "snappy")
    met = sides.join(least, F.col("u") == F.col("node"))
    if large:
        new = met.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        new = met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("node")))
    out = written(new.filter(F.col("a") < F.col("b")).distinct(), "stars", "snappy")
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    edges: two columns of one orderable type; direction, repeats and loops don't matter, and an edge with a
    null end is none. Every round is written in the shared folder, so a lost executor costs one round at most.
    """
    a, b = edges.columns
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a) < F.col(b)).alias("c"), (F.col(a) == F.col(b)).alias("e"))
    pairs = written(ends.filter(F.col("c").isNotNull() & ~F.col("e")).select("a", "b").distinct(), "edges", "snappy")
    before = _state(pairs)
    while before[0]:
        large = _star(pairs, True)
        small = _star(large, False)
        discard(large)
        now = _state(small)
        discard(pairs)
        pairs = small
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(pairs.select(F.col("a"), F.col("a")).distinct())
