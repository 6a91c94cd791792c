"""Order statistics of groups of any size: prefix sums over sampled ranges, exact ranks, exact medians by narrowing.

No task holds a group: values are dealt to ranges by their order, ranges are summed, and what is carried between
ranges is one row for each group and range. Tables that several steps read are written in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range holds on average.
RANGE_ROWS = 200_000
#: Values that are sorted in one array; beyond, the range that holds the middle is narrowed first.
FEW = 20_000
#: Cells of the grid that narrows a range, and the accuracy of its quantiles (rank error 1 / ACCURACY).
CELLS, ACCURACY = 200, 2000
#: Rows of a table of groups up to which it is broadcast.
SMALL = 100_000


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written in the shared folder and read again."""
    from ..sources.tables import new_path

    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in columns], F.lit(True))


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], sums: list[str], rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """rows with <sum>_before, the sum over the group's rows that are earlier in `order`, and <sum>_total over the group.

    Rows of one group need different values of `order`; a null group is a group.
    """
    rows = stored(rows, "values")
    ranges = -(-rows.count() // rows_per_range) or 1
    dealt = rows.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in (*group, *order)])
    dealt = stored(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*group, "__range").agg(*[F.sum(s).alias(s) for s in sums])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    heads = totals.select(
        *[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__at"),
        *[F.coalesce(F.sum(s).over(earlier), nothing).alias(f"__{s}") for s in sums], *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )
    within = Window.partitionBy(*group, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(within), nothing) for s in sums})
    on = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__range") == F.col("__at"))
    joined = dealt.join(heads, on).withColumns({f"{s}_before": F.col(f"{s}_before") + F.col(f"__{s}") for s in sums})
    return joined.drop("__range", "__at", *[f"__{g}" for g in group], *[f"__{s}" for s in sums])


def rank_within(df: DataFrame, group: str, value: str, descending: bool = True, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """df with rank (ties share the best), percent_rank (0 to 1) and group_rows, within groups that may be huge.

    Equal values are counted once before anything is ordered, so ties cost nothing, and rows meet their rank by a join
    that Spark splits where one value is frequent. Null values have no rank and don't count.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__group"), F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("n"))
    sums = prefix_sums(counts, ["__group"], ["__value"], ["n"], rows_per_range)
    ahead = F.col("n_total") - F.col("n_before") - F.col("n") if descending else F.col("n_before")
    ranks = sums.select("__group", "__value", (ahead + 1).alias("rank"), F.coalesce(F.try_divide(ahead, F.col("n_total") - 1), F.lit(0.0)).alias("percent_rank"), F.col("n_total").alias("group_rows"))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("__group")) & (F.col(value) == F.col("__value")), "left").drop("__group", "__value")


def exact_medians(df: DataFrame, columns: list[str], group: list[str] | None = None, few: int = FEW) -> DataFrame:
    """(group..., feature, median) of the values that are there; groups and columns without any are left out.

    Mergeable quantile sketches give a narrow range around the middle, exact counts say whether the middle lies in
    it, on one of its ends, or beside it; then only the rows within are looked at, until `few` are left, which one array
    holds. Ends are cut off with all their ties, so that ties never keep a range wide. All groups and columns go
    side by side. The median of an even number of values is the mean of the two middle ones; NaN is the largest value.
    """
    group = group or []
    keys = [*group, "feature"]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    values = stored(df.select(*group, F.explode(cells).alias("__v")).select(*group, "__v.*").filter("x is not null"), "median-values")
    null = F.lit(None).cast("double")
    state = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    state = state.withColumns({"k": F.floor((F.col("n") - 1) / 2), "m": F.col("n"), "below": F.lit(0).cast("long"), "lo": null, "hi": null, "low_middle": null})
    state, done = stored(state, "median-state"), []

    def meet(of: DataFrame) -> DataFrame:
        of = of.withColumnsRenamed({c: f"__{c}" for c in keys})
        of = F.broadcast(of) if of.count() <= SMALL else of
        return values.join(of, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])).drop(*[f"__{c}" for c in keys])

    x, kept = F.col("x"), ["n", "k", "m", "below", "lo", "hi"]
    while not state.isEmpty():
        rows = meet(state).filter((F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x < F.col("hi"))))
        small = rows.filter(F.col("m") <= few).groupBy(*keys, *kept).agg(F.array_sort(F.collect_list("x")).alias("__all"))
        done.append(stored(small.select(*keys, "n", "k", F.get("__all", (F.col("k") - F.col("below")).cast("int")).alias("low_middle")), "median-found"))
        large = state.filter(F.col("m") > few)
        if large.isEmpty():
            break
        grid = rows.filter(F.col("m") > few).groupBy(*keys, *kept).agg(F.percentile_approx("x", [i / CELLS for i in range(CELLS + 1)], ACCURACY).alias("__grid"))
        cell = F.floor((F.col("k") - F.col("below")) * CELLS / F.col("m")).cast("int")
        ends = grid.select(*keys, *kept, F.get("__grid", F.greatest(cell - 1, F.lit(0))).alias("a"), F.get("__grid", F.least(cell + 2, F.lit(CELLS))).alias("b"))
        ends = stored(ends, "median-ends")
        inside = meet(ends).filter((F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x < F.col("hi"))))
        a, b = F.col("a"), F.col("b")
        counts = inside.groupBy(*keys, *kept, "a", "b").agg(
            F.count_if(x < a).alias("n1"), F.count_if(x == a).alias("n2"), F.count_if((x > a) & (x < b)).alias("n3"), F.count_if((x == b) & (b > a)).alias("n4"), F.count_if(x > b).alias("n5"),
        )
        r = F.col("k") - F.col("below")
        up = [F.col("n1"), F.col("n1") + F.col("n2"), F.col("n1") + F.col("n2") + F.col("n3"), F.col("n1") + F.col("n2") + F.col("n3") + F.col("n4")]
        place = F.when(r < up[0], 1).when(r < up[1], 2).when(r < up[2], 3).when(r < up[3], 4).otherwise(5)
        counts = stored(counts.withColumn("__place", place), "median-counts")
        found = counts.filter("__place in (2, 4)").select(*keys, "n", "k", F.when(F.col("__place") == 2, a).otherwise(b).alias("low_middle"))
        done.append(found)
        p, size = F.col("__place"), lambda c: F.col(c)
        state = counts.filter("__place in (1, 3, 5)").select(
            *keys, "n", "k",
            F.when(p == 1, size("n1")).when(p == 3, size("n3")).otherwise(size("n5")).alias("m"),
            (F.col("below") + F.when(p == 1, 0).when(p == 3, up[1]).otherwise(up[3])).alias("below"),
            F.when(p == 1, F.col("lo")).when(p == 3, a).otherwise(b).alias("lo"),
            F.when(p == 1, a).when(p == 3, b).otherwise(F.col("hi")).alias("hi"),
        )
        state = stored(state, "median-state")
    middles = reduce(DataFrame.unionByName, done) if done else None
    if middles is None:
        return state.select(*keys, F.lit(None).cast("double").alias("median"))
    odd = F.col("n") % 2 == 1
    even = meet(middles.filter(~odd)).groupBy(*keys, "n", "k", "low_middle").agg(F.count_if(x <= F.col("low_middle")).alias("__le"), F.min(F.when(x > F.col("low_middle"), x)).alias("__next"))
    other = F.when(F.col("__le") > F.col("k") + 1, F.col("low_middle")).otherwise(F.col("__next"))
    return middles.filter(odd).select(*keys, F.col("low_middle").alias("median")).unionByName(even.select(*keys, (0.5 * F.col("low_middle") + 0.5 * other).alias("median")))
