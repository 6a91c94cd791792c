"""Matching of company names by token-sort similarity: a set-similarity join that loses no pair.

The ratio of two names, their words in order, is 200 L / (|a| + |b|) with L the length of their longest common
subsequence. Names at a ratio of 100 t or more have lengths within t / (2 - t) of each other and share at least
L - (q - 1) (D + 1) of their q-grams, D = |a| + |b| - 2 L being what they don't share: so at least
needed(s) = ceil(t s / 2) - (q - 1) ((1 - t) s + 1) for a joint length s. Two sets that share k of their elements meet in the
rarest |set| - k + 1 of each, in one order of all q-grams by their frequency: only those are joined. Joint lengths
that are too short for q-grams to be needed are joined by single characters, of which at least L are shared.

Short joint lengths leave room for one character too many at most. Such names are equal, or the longer without one
character is the shorter: they are joined by whole names, so names that share a long beginning cost nothing.

The best match of a name is sought from high ratios to low ones. At a high one few q-grams are joined; a name whose
best is there needs no lower one, as every name at that ratio or more was a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import normalize_name
from .ranges import stored

#: Ratios at which best matches are sought in turn, and the q-grams that are joined at each.
LEVELS = ((0.9, 3), (0.8, 2), (0.7, 2), (0.6, 1))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """100 * 2 LCS / (lengths); two equal texts, empty ones too, are 100."""
    return 100.0 if a == b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The ratio of the names with their words in order."""
    tidy = lambda t: " ".join(sorted((t or "").split()))
    return pd.Series([ratio_of(tidy(a), tidy(b)) for a, b in zip(left, right)], dtype="float64")


def ordered(name: Column) -> Column:
    """A normalised name with its words in order; null where there is no name."""
    words = F.filter(F.split(normalize_name(name), " "), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.array_sort(words), " "))


def grams(text: Column, q: int) -> Column:
    """A text's q-grams, the n-th of equal ones marked by n, so that a set of them is a multiset."""
    n = F.length(text)
    plain = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(q))))
    plain = F.when(n >= q, plain).otherwise(F.array().cast("array<string>"))
    return F.transform(plain, lambda g, i: F.concat(g, F.lit("\x00"), (i - F.array_position(plain, g) + 1).cast("string")))


def needed(joint: Column, ratio: float, q: int) -> Column:
    """q-grams that two texts of a joint length share at least, if their ratio is that or more."""
    return F.ceil(joint * ratio / 2 - (q - 1) * ((1 - ratio) * joint + 1) - 1e-9)


def shortest(ratio: float, q: int) -> int:
    """The joint length from which on at least one q-gram is needed; q-grams that are never needed are an error."""
    if ratio / 2 - (q - 1) * (1 - ratio) <= 0:
        raise ValueError(f"{q}-grams can't find a ratio of {ratio}")
    return math.ceil(q / (ratio / 2 - (q - 1) * (1 - ratio)))


def longest_of_one(ratio: float) -> int:
    """The joint length up to which two texts at a ratio differ by one character too many at most."""
    return math.floor((2 - 1e-6) / (1 - ratio))


def fitting(a: Column, b: Column, ratio: float) -> Column:
    """Whether two lengths leave room for a ratio."""
    return 200.0 * F.least(a, b) >= (a + b) * ratio * 100 - 1e-6


def _one_more(left: DataFrame, right: DataFrame, ratio: float, most: int) -> DataFrame:
    """(l, r): pairs of texts, of a joint length up to most, that are equal or one of which has a character more."""
    n = F.length("t")

    def shortened(side: DataFrame, whole: str, less: str) -> DataFrame:
        without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, n)))
        rows = side.filter(fitting(n, n - 1, ratio) & (2 * n - 1 <= most))
        return rows.select(F.col("t").alias(whole), F.explode(F.array_distinct(without)).alias(less))

    l, r = left.select(F.col("t").alias("l")), right.select(F.col("t").alias("r"))  # noqa: E741
    same = l.join(r, F.col("l") == F.col("r")).filter(2 * F.length("l") <= most)
    return same.unionByName(shortened(left, "l", "r").join(r, "r")).unionByName(shortened(right, "r", "l").join(l, "l"))


def _joined(left: DataFrame, right: DataFrame, ratio: float, q: int, least: int, most: int | None) -> DataFrame:
    """(l, r): pairs of texts that share one of their rarest q-grams, with a joint length between least and most."""
    def tokens(side: DataFrame) -> DataFrame:
        n = F.length("t")
        rows = side.filter(n * (1 + (2 - ratio) / ratio) >= least)
        if most is not None:
            rows = rows.filter(n * (1 + ratio / (2 - ratio)) <= most)
        return rows.select("t", grams(F.col("t"), q).alias("g"))

    sides = [stored(tokens(s), "grams") for s in (left, right)]
    known = sides[0].select(F.explode("g").alias("gram")).unionAll(sides[1].select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    known = stored(known, "gram-counts")

    def prefix(side: DataFrame, name: str) -> DataFrame:
        """The rarest grams of each text, as many as its shortest partner leaves open."""
        rows = side.select("t", F.explode("g").alias("gram")).join(known, "gram").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("g"))
        short = F.greatest(F.length("t") * (1 + ratio / (2 - ratio)), F.lit(float(least)))
        keep = F.size("g") - F.greatest(needed(short, ratio, q), F.lit(1)) + 1
        return rows.select(F.col("t").alias(name), F.explode(F.slice("g", F.lit(1), F.greatest(keep, F.lit(0)).cast("int"))["gram"]).alias("gram"))

    pairs = prefix(sides[0], "l").join(prefix(sides[1], "r"), "gram").select("l", "r")
    a, b = F.length("l"), F.length("r")
    fits = fitting(a, b, ratio) & (a + b >= least)
    return pairs.filter(fits & (a + b <= most) if most is not None else fits).distinct()


def candidates(left: DataFrame, right: DataFrame, ratio: float, q: int) -> DataFrame:
    """(l, r) of all pairs of texts (t) at a ratio or more, and some more."""
    if ratio >= 1:
        return left.select(F.col("t").alias("l")).join(right.select(F.col("t").alias("r")), F.col("l") == F.col("r"))
    one = longest_of_one(ratio)
    at, pairs = max(shortest(ratio, q), one + 1), _one_more(left, right, ratio, one)
    if at > one + 1:
        pairs = pairs.unionByName(_joined(left, right, ratio, 1, one + 1, at - 1))
    return pairs.unionByName(_joined(left, right, ratio, q, at, None))


def scored(pairs: DataFrame, ratio: float) -> DataFrame:
    """(l, r, score) of pairs at a ratio or more."""
    least = 100 * ratio - 1e-9

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.assign(score=[ratio_of(x, y) for x, y in zip(b["l"], b["r"])])
            yield rows[rows["score"] >= least]

    return pairs.mapInPandas(score, "l string, r string, score double")


def similar_names(left: DataFrame, right: DataFrame, ratio: float = 0.75, q: int = 2) -> DataFrame:
    """(l, r, score) of all pairs of different ordered names of two tables (company_name; name) at a ratio or more."""
    texts = lambda df, c: df.select(ordered(F.col(c)).alias("t")).filter("t is not null").distinct()
    return scored(candidates(texts(left, "company_name"), texts(right, "name"), ratio, q), ratio)


def fuzzy_match_names(left: DataFrame, right: DataFrame, threshold: float = 60, levels: tuple[tuple[float, int], ...] = LEVELS) -> DataFrame:
    """Per left row (company_name, cin, ...) the best right row (code, name, place): code, name, score.

    The first of equal scores wins. What no level finds has no code, no name and no score, so the lowest level should
    not lie above the threshold. Equal names are compared once; rows of left that are equal in everything stay as many.
    """
    names = stored(right.select("code", "name", "place", ordered(F.col("name")).alias("r")).filter("r is not null"), "names")
    rows = stored(left.withColumn("l", ordered(F.col("company_name"))), "companies")
    first = names.groupBy("r").agg(F.min(F.struct("place", "code", "name")).alias("of"))
    open_, texts, best = stored(rows.select(F.col("l").alias("t")).filter("t is not null").distinct(), "open"), names.select(F.col("r").alias("t")).distinct(), None
    for ratio, q in levels:
        found = scored(candidates(open_, texts, ratio, q), ratio).join(first, "r")
        key = F.struct((-F.col("score")).alias("s"), F.col("of.place").isNull().alias("no_place"), F.col("of.place").alias("place"), F.col("of.code").alias("code"), F.col("of.name").alias("name"))
        found = stored(found.groupBy("l").agg(F.min(key).alias("best")), "best")
        best = found if best is None else best.unionByName(found)
        open_ = stored(open_.join(found.select(F.col("l").alias("t")), "t", "left_anti"), "open")
    good = -F.col("best.s") >= threshold
    out = rows.join(best, "l", "left")
    return out.select(*left.columns, F.when(good, F.col("best.code")).alias("code"), F.when(good, F.col("best.name")).alias("name"), F.bround(-F.col("best.s"), 2).alias("score"))


def exclude_similar(controls: DataFrame, listed: DataFrame, threshold: float = 90, q: int = 2) -> DataFrame:
    """Controls whose name is at a ratio of the threshold or more to no name on a list (company_name); rows without a name stay."""
    hits = similar_names(controls, listed.select(F.col("company_name").alias("name")), threshold / 100, q).select("l").distinct()
    return controls.withColumn("__l", ordered(F.col("company_name"))).join(hits, F.col("__l") == F.col("l"), "left_anti").drop("__l")


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalize_name(name), " ")), " ")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """100 * (1 - distance / longer length) of the names with their words in order."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (longest - F.levenshtein(x, y)) / longest)


def match_tier(similarity: Column) -> Column:
    return F.when(similarity >= 90, "auto").when(similarity >= 85, "verify").otherwise("manual")
