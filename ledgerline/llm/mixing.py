"""Mixing sources to target weights, with distributed prefix sums.

Each source gets a budget of words. Its documents are put in the order of a random hash; whole epochs of it
are taken while the budget lasts, and of the last epoch a prefix in hash order up to the budget exactly. The
document at the cut is taken in part: its first words.

The order's hash range is cut into buckets of even expected size. A running sum within a bucket, plus the sum
of the source's earlier buckets, is the prefix sum, so that no task holds a source whole.

A null text has size 0 and is never taken in part. A null source is a source, ordered last. Documents that
are equal in id and text are interchangeable in the order. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, prefix_offsets, word_count, written

#: Weights by the place of a source in code point order, repeating.
CYCLE = (3, 1, 2)
#: Words that the mix takes, as a multiple of all words.
SHARE = 1.5
#: A source gives at most so many times its own words.
MOST_EPOCHS = 2
#: Hash ranges that a source's documents are dealt to, as hex digits of the hash: 16 ** 3.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = CYCLE, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words per source: by weight, none above `most` times its size, what that leaves reshared by weight.

    sizes: source, source_size. Sources in the order of size over weight reach their limits first; the level
    at which the rest share what is left is the first that the next source does not exceed. One row per source
    goes through these windows, never a row per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("__limit", F.col("source_size") * most).withColumn("__ratio", F.col("__limit") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "__level",
        (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__limit").over(before), F.lit(0)))
        / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    ).withColumn("__place", F.row_number().over(fill))
    level = F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__place", "__level"))).over(whole)["__level"]
    target = F.when(level.isNull() | (F.col("__ratio") <= level), F.col("__limit").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def order_hash(key: Column, text: Column, seed: int) -> Column:
    """The hex hash that orders a source's documents."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), part(key), F.lit("|"), part(text)).cast("binary"))


def mix(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", targets=source_targets) -> DataFrame:
    """docs with size, source_size, target, budget and taken: the words that the mix takes of each document.

    taken is size times the whole epochs, plus what the last epoch's cut leaves of the document. Columns of
    docs that have these names are replaced.
    """
    made = ["size", "source_size", "target", "budget", "taken"]
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept, word_count(F.col(text)).alias("size"), order_hash(F.col(key), F.col(text), seed).alias("__hash"))
    rows = rows.withColumn("__range", F.substring("__hash", 1, RANGE_DIGITS))
    totals = rows.groupBy(F.col(source).alias("source"), "__range").agg(F.sum("size").alias("__n"))
    totals = written(totals, "mix-ranges")
    budgets = targets(totals.groupBy("source").agg(F.sum("__n").alias("source_size")))
    ranges = prefix_offsets(totals, ["source"], "__range", "__n").drop("group_total", "__n")
    ranges = ranges.join(budgets.withColumnRenamed("source", "__of"), F.col("source").eqNullSafe(F.col("__of")))
    ranges = ranges.select(F.col("source").alias("__source"), F.col("__range").alias("__at"), F.col("offset").alias("__offset"), "source_size", "target")
    earlier = Window.partitionBy(source, "__range").orderBy("__hash", F.col(key), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    rows = rows.join(ranges, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__at")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size") - F.col("__offset") - F.col("__before")
    rows = rows.withColumn("budget", budget)
    rows = rows.withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size"))))
    return rows.select(*kept, *made)


def first_words(text: Column, n: Column) -> Column:
    """A text up to and with its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"(?:{GAP})?{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_rows(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mix as documents: a row for each time a document is taken whole, and its first words where taken in part."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    parts = F.concat(
        F.when(whole > 0, F.array_repeat(F.lit(None).cast("long"), whole.cast("int"))).otherwise(F.array().cast("array<bigint>")),
        F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    rows = mixed.filter(F.col("taken") > 0).withColumn("__part", F.explode(parts))
    cut = F.when(F.col("__part").isNull(), F.col(text)).otherwise(first_words(F.col(text), F.col("__part")))
    return rows.withColumn(text, cut).select(*columns)
