"""Summaries, missingness, validation and imputation statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_listed, is_valid_cin, normalize_name, normalize_text, number, parse_year
from .ranges import exact_medians


def dataset_summary(df: DataFrame, label: str = "target_wilful_default", company: str = "cin") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(company).alias("n_companies"))


def null_names(columns: list[str]) -> Column:
    """The names of a row's missing columns; blank text is missing."""
    return F.filter(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]), lambda x: x.isNotNull())


def missingness_summary(df: DataFrame, columns: list[str], company: list[str]) -> DataFrame:
    """Per company with missing cells: rows and cells missing, and the sorted field names. Cells are counted before names are exploded."""
    rows = df.select(*company, null_names(columns).alias("names")).filter(F.size("names") > 0)
    return rows.groupBy(*company).agg(
        F.count(F.lit(1)).alias("rows_with_missing"),
        F.sum(F.size("names")).alias("missing_cells"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("fields"),
    ).withColumns({"distinct_missing_fields": F.size("fields").cast("long"), "missing_columns": F.array_join("fields", "|")}).drop("fields")


def validate_dataset(df: DataFrame, label: str = "target_wilful_default") -> DataFrame:
    """(rule, key, n): too few classes, repeated (cin, year), companies with two labels. One exchange by cin serves the last two."""
    years = df.groupBy("cin", "financial_year").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    labels = df.groupBy("cin").agg(F.countDistinct(label).alias("n")).filter("n > 1")
    classes = df.agg(F.countDistinct(label).alias("n")).filter("n < 2")
    return (
        years.select(F.lit("duplicate_company_year").alias("rule"), F.concat_ws(":", "cin", "financial_year").alias("key"), "n")
        .unionByName(labels.select(F.lit("several_labels").alias("rule"), F.col("cin").alias("key"), "n"))
        .unionByName(classes.select(F.lit("fewer_than_two_classes").alias("rule"), F.lit("").alias("key"), "n"))
    )


def strict(violations: DataFrame) -> None:
    """Raise with up to 20 violations, if there are any."""
    found = violations.limit(20).collect()
    if found:
        raise ValueError("; ".join(str(tuple(r)) for r in found))


def validate_cohorts(df: DataFrame, kind: str, expected_rows: int | None = None) -> DataFrame:
    """(rule, row, value) for a company list of text columns with source_row; kind: "defaulter" or "control"."""
    def fails(rule: str, test: Column, value: str) -> DataFrame:
        return df.filter(test).select(F.lit(rule).alias("rule"), F.col("source_row").alias("row"), F.col(value).cast("string").alias("value"))

    blank = lambda c: normalize_text(F.col(c)) == ""
    checks = [fails("cin_missing", blank("cin"), "cin"), fails("cin_invalid", ~blank("cin") & ~is_valid_cin(F.col("cin")), "cin"), fails("sector_missing", blank("sector"), "sector")]
    checks.append(fails("amount_not_a_number", ~blank("amount_crore") & number(F.col("amount_crore").cast("string")).isNull(), "amount_crore"))
    if kind == "defaulter":
        year = parse_year(F.col("default_year"))
        checks.append(fails("cin_not_listed", ~blank("cin") & ~is_listed(F.col("cin")), "cin"))
        checks.append(fails("default_year_out_of_range", ~blank("default_year") & ~F.coalesce(year.between(2010, 2030), F.lit(False)), "default_year"))
        checks.append(fails("fy_before_default_missing", blank("fy_before_default"), "fy_before_default"))
    again = df.groupBy(normalize_name(F.col("company_name")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("row")).filter("n > 1")
    checks.append(again.select(F.lit("duplicate_name").alias("rule"), "row", "value"))
    if expected_rows is not None:
        checks.append(df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected_rows).select(F.lit("row_count").alias("rule"), F.lit(None).cast("long").alias("row"), F.col("n").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, checks)


REQUIRED_TO_SCORE = ("company_name", "cin", "financial_year", "sector", "revenue", "pat", "interest_expense", "tax_expense", "total_equity", "total_borrowings", "total_assets", "cfo")


def validate_scoring_input(df: DataFrame, single_company: bool = False) -> DataFrame:
    """(rule, n) of what keeps raw rows from being scored; counted in one pass, repeated years by a group."""
    absent = [c for c in REQUIRED_TO_SCORE if c not in df.columns]
    spark = df.sparkSession
    if absent:
        return spark.createDataFrame([(f"column_missing:{c}", 1) for c in absent], "rule string, n long")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    tests = {f"blank:{c}": F.count_if(blank(c)) for c in ("company_name", "cin", "sector", "financial_year")}
    derivable = F.col("pat").isNotNull() & F.col("interest_expense").isNotNull() & F.col("tax_expense").isNotNull()
    derivable = derivable & (F.col("depreciation").isNotNull() if "depreciation" in df.columns else F.lit(False))
    given = F.col("ebitda").isNotNull() if "ebitda" in df.columns else F.lit(False)
    tests["no_rows"] = F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long")
    tests["ebitda_unknown"] = F.when(F.count_if(given) == 0, F.count_if(~derivable)).otherwise(0).cast("long")
    if single_company:
        tests["several_companies"] = F.when(F.countDistinct("cin") > 1, F.countDistinct("cin")).otherwise(0).cast("long")
    counts = df.agg(*[v.alias(k) for k, v in tests.items()])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in tests])).alias("x")).select("x.*")
    again = df.groupBy("cin", "financial_year").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_company_year").alias("rule"), "n")
    return long.unionByName(again).filter("n > 0")


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature) of columns with one value at most, null being a value: smallest = largest and no null, or all null."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.count(c).alias("n"), F.count(F.lit(1)).alias("all")).alias(c) for c in columns])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])).alias("y")).select("y.feature", "y.x.*")
    return long.filter((F.col("n") == 0) | ((F.col("n") == F.col("all")) & (F.col("lo") == F.col("hi")))).select("feature")


def median_impute_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median) of every column, null where it has no value."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(exact_medians(df, columns), "feature", "left").select("feature", "median")


def mode_impute_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mode): the most frequent value, the smallest of equals. Counts per value come first, so one row a value is compared."""
    parts = []
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.max("n").alias("m"))
        parts.append(counts.join(F.broadcast(best), F.col("n") == F.col("m")).agg(F.min("v").alias("mode")).select(F.lit(c).alias("feature"), "mode"))  # best is one row
    return reduce(DataFrame.unionByName, parts)


#: Lanes of a fingerprint: eight 32-bit words of a row's SHA-256, each summed modulo 2^64.
LANES = 8


def fingerprint_lanes(df: DataFrame) -> DataFrame:
    """One row (n, lane_0, ... lane_7): an additive hash of the multiset of rows, which no order or partitioning changes.

    A row's digest is over its columns in order, each "-" for null, else its length in bytes, ":", and its text, so that no two
    rows read alike. Lanes of parts of a table add up to those of the whole; see merged_lanes.
    """
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    digest = F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)
    word = lambda i: F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return merged_lanes(df.select(digest.alias("digest")).select(F.lit(1).cast("long").alias("n"), *[word(i).alias(f"lane_{i}") for i in range(LANES)]))


def merged_lanes(parts: DataFrame) -> DataFrame:
    """The lanes of the union of parts, from one row of lanes for each."""
    lane = lambda i: (F.coalesce(F.sum(f"lane_{i}"), F.lit(0)) % F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"lane_{i}")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), *[lane(i) for i in range(LANES)])


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row: the number of rows, and the SHA-256 of it and the lanes."""
    return fingerprint_lanes(df).select(F.col("n").alias("n_rows"), F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"lane_{i}").cast("string") for i in range(LANES)]), 256).alias("fingerprint"))


def fill_rate(columns: list[str]) -> Column:
    """Number of a row's fields that aren't blank."""
    return sum((F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in columns), F.lit(0))


def cohort_comparison(features: DataFrame) -> DataFrame:
    return features.groupBy("cohort").agg(
        F.avg("debt_to_equity").alias("avg_debt_to_equity"),
        (100 * F.avg("auditor_qualification_flag")).alias("qualified_pct"),
        (100 * F.avg("rpt_to_revenue_ratio")).alias("avg_rpt_pct_revenue"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def lender_sector_exposure(df: DataFrame, bank: str, sector: str, amount: str, year: str | None = None) -> DataFrame:
    """Rows and amount by bank, sector and, where it is given, year, with subtotals and a total."""
    return df.rollup(bank, sector, *([year] if year else [])).agg(F.count(F.lit(1)).alias("n_defaulters"), F.sum(F.col(amount).cast("decimal(18,4)")).cast("double").alias("amount"))


def data_quality_score(df: DataFrame, columns: list[str], company: list[str], most_missing: float = 0.3) -> DataFrame:
    """Per company the share of cells that are there, and whether too many are missing."""
    share = F.size(null_names(columns)) / F.lit(float(len(columns)))
    return df.groupBy(*company).agg((1 - F.avg(share)).alias("quality_score")).withColumn("excluded", F.col("quality_score") < 1 - most_missing)


def sector_median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values filled by the median of year and sector, joined from a table of one row per group."""
    keys = ["sector", "financial_year"]
    medians = exact_medians(df, columns, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"__{c}") for c in columns])
    return df.join(medians, keys, "left").withColumns({f"{c}_imputed": F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])
