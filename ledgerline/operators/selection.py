"""Splits without leakage, and feature selection on training rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE_ROWS, prefix_sums, stored

FRACTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, the same in every engine: 28 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def company_split(df: DataFrame, company: str = "cin", fractions: dict[str, float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """df with a column `split`: all rows of a company fall in one split, by a hash of its id.

    The hash is uniform within each label, so that labels are stratified in expectation; no shuffle, no state,
    and a company never changes its split when others are added.
    """
    share, bound, split = hash_share(F.col(company), seed), 0.0, None
    for name, f in fractions.items():
        bound += f
        split = F.when(share < round(bound, 12), name) if split is None else split.when(share < round(bound, 12), name)
    return df.withColumn("split", split.otherwise(list(fractions)[-1]))


def stratified_split(df: DataFrame, label: str, company: str = "cin", fractions: dict[str, float] = FRACTIONS, seed: int = 42, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """df with a column `split`: of each label's companies exactly the fractions, in the order of a hash of their ids.

    One row for each company is ranked within its label over ranges of the hash, so that two labels are not two tasks. A
    company with several labels has the largest. The counts are checked: every split has two classes or more, and
    they add up to all companies; otherwise it is an error, as on a table of one class.
    """
    companies = df.groupBy(F.col(company).alias("__company")).agg(F.max(label).alias("__label"))
    companies = companies.withColumns({"__hash": F.md5(F.concat("__company", F.lit(f":{seed}")).cast("binary")), "n": F.lit(1).cast("long")})
    placed, bound, split = prefix_sums(companies, ["__label"], ["__hash", "__company"], ["n"], rows_per_range), 0.0, None
    for name, f in fractions.items():
        bound += f
        inside = F.col("n_before") < F.floor(F.col("n_total") * round(bound, 12) + 0.5)
        split = F.when(inside, name) if split is None else split.when(inside, name)
    placed = stored(placed.select("__company", "__label", split.otherwise(list(fractions)[-1]).alias("split")), "splits")
    counts = placed.groupBy("split").agg(F.countDistinct("__label").alias("labels"), F.count(F.lit(1)).alias("n")).collect()  # one row a split
    if short := sorted(set(fractions) - {r["split"] for r in counts if r["labels"] > 1}):
        raise ValueError(f"splits of fewer than two classes: {', '.join(short)}")
    if (total := sum(r["n"] for r in counts)) != placed.count():
        raise ValueError(f"splits hold {total} companies")
    placed = placed.drop("__label")
    return df.join(placed, F.col(company).eqNullSafe(F.col("__company"))).drop("__company")


def split_counts(df: DataFrame, label: str) -> DataFrame:
    """Companies and rows by split and label, to see that every split has both classes."""
    return df.groupBy("split", label).agg(F.countDistinct("cin").alias("n_companies"), F.count(F.lit(1)).alias("n_rows"))


def temporal_split(df: DataFrame, last_train_year: int, default_year: str = "default_year", company: str = "cin", train_share: float = 0.7, seed: int = 42) -> DataFrame:
    """Training on companies of earlier default years, testing on later ones; all years of a company fall on one side.

    A company's default year is its first. Companies without one are dealt by a hash of their id.
    """
    first = F.min(default_year).over(Window.partitionBy(company))
    train = F.when(first.isNotNull(), first <= last_train_year).otherwise(hash_share(F.col(company), seed) < train_share)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def leakage_cutoff(df: DataFrame, years: int = 3, default_year: str = "default_year") -> DataFrame:
    """Company-years that lie at least so many years before the default; those without one all stay."""
    return df.filter(F.col(default_year).isNull() | (F.col("financial_year") <= F.col(default_year) - years))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): absolute Pearson correlation of each two columns over the rows that have both, a before b.

    Each task sums masked products into p x p matrices, whose cells are added up by Spark: the shuffle is one row
    per cell and task, however many rows there are. Values are taken from the column's least one, so that a spread that
    is small against the values is not lost, and a column of one value has no variance. r is null where a variance is 0.
    """
    p = len(columns)
    least = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in columns]).first()
    least = np.array([0.0 if least is None or v is None or not np.isfinite(v) else v for v in (least or [None] * p)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch[columns].to_numpy(float) - least
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        i, j = np.triu_indices(p, 1)
        yield pd.DataFrame({"i": i, "j": j, "n": total[0][i, j], "sx": total[1][i, j], "sy": total[1][j, i], "sxx": total[2][i, j], "syy": total[2][j, i], "sxy": total[3][i, j]})

    cells = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    cells = cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    r = F.abs(F.try_divide(n * F.col("sxy") - sx * sy, F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy))))
    names = F.array(*[F.lit(c) for c in columns])
    return cells.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), r.alias("r"))


def correlation_filter(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(feature) of columns that correlate too much with an earlier one, dropped or not."""
    return pairs.filter(F.col("r") > threshold).select(F.col("b").alias("feature")).distinct()


def select_training_columns(df: DataFrame, ids: list[str], label: str, excluded: list[str], text: list[str]) -> DataFrame:
    """Ids and label first, then all columns that are neither text nor excluded, in their order."""
    absent = [c for c in (*ids, label) if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    first = [*ids, label]
    return df.select(*first, *[c for c in df.columns if c not in {*first, *excluded, *text}])
