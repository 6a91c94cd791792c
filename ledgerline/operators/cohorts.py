"""Company lists, pending work and joins on identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_valid_cin, normalize_cin, normalize_name, normalize_text


def rows_with_cin(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cin").isNotNull())


def rows_missing_cin(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cin").isNull())


def union_cohorts(defaulters: DataFrame, controls: DataFrame) -> DataFrame:
    """Both lists with their cohort; rows need a name and an id."""
    both = defaulters.withColumn("cohort", F.lit("defaulter")).unionByName(controls.withColumn("cohort", F.lit("non_defaulter")), allowMissingColumns=True)
    return both.filter((normalize_text(F.col("company_name")) != "") & (normalize_text(F.col("cin")) != ""))


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def pending_companies(companies: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Companies with an id that no checkpoint row marks as a success."""
    success = done.filter(F.col("status") == "success").select(F.col("cin").alias("__done"))
    rows = rows_with_cin(companies).join(success, F.col("cin") == F.col("__done"), "left_anti")
    return rows.orderBy("cin", "company_name").limit(limit) if limit else rows


def pending_company_years(companies: DataFrame, plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned years of the companies that are not in the checkpoint."""
    years = plan.select(F.col("cin").alias("__cin"), F.col("target_fy").alias("financial_year")).distinct()
    rows = companies.join(years, F.col("cin") == F.col("__cin")).drop("__cin")
    return rows.join(done.select("cin", "financial_year"), ["cin", "financial_year"], "left_anti")


def pipeline_status(companies: DataFrame, done: DataFrame) -> DataFrame:
    """Rows with an id, done and pending; repeated rows count each."""
    success = done.filter(F.col("status") == "success").select(F.col("cin").alias("__done")).distinct()
    rows = rows_with_cin(companies).join(success, F.col("cin") == F.col("__done"), "left")
    return rows.agg(F.count(F.lit(1)).alias("with_cin"), F.count("__done").alias("done"), F.count_if(F.col("__done").isNull()).alias("pending"))


def fill_cin_from_resolved(companies: DataFrame, resolved: DataFrame) -> DataFrame:
    """Ids that aren't valid are taken from the resolver's last entry for the name (resolved: company_name, cin, seq)."""
    last = resolved.groupBy(F.trim("company_name").alias("__name")).agg(F.max_by("cin", "seq").alias("__cin"))
    rows = companies.join(last, F.trim("company_name") == F.col("__name"), "left")
    return rows.withColumn("cin", F.when(is_valid_cin(F.col("cin")), F.col("cin")).otherwise(F.coalesce("__cin", "cin"))).drop("__name", "__cin")


def exclude_listed(controls: DataFrame, defaulters: DataFrame) -> DataFrame:
    """Controls whose normalised name is on no defaulter list."""
    names = defaulters.select(normalize_name(F.col("company_name")).alias("__name")).distinct()
    return controls.join(names, normalize_name(F.col("company_name")) == F.col("__name"), "left_anti")


def attach_report_ids(values: DataFrame, manifest: DataFrame) -> DataFrame:
    """Extracted values with the ids of the manifest, by file name."""
    return values.join(manifest, "filename")


def drop_unusable_rows(df: DataFrame, needed: list[str]) -> DataFrame:
    """Without rows that are null throughout, or in all of the needed columns that there are."""
    rows = df.dropna("all")
    there = [c for c in needed if c in df.columns]
    return rows.dropna("all", subset=there) if there else rows.limit(0)


def link_manifest_filter(links: DataFrame, keywords: list[str], preferred: list[str]) -> DataFrame:
    """Per page, the links of the best tier: a keyword in address or text, else a preferred path, else all (links: page_id, href, text)."""
    has = lambda c, words: F.coalesce(F.greatest(*[F.contains(c, F.lit(w)) for w in words], F.lit(False)), F.lit(False))
    tier = F.when(has(F.lower("href"), keywords) | has(F.lower("text"), keywords), 1).when(has(F.col("href"), preferred), 2).otherwise(3)
    rows = links.withColumn("tier", tier)
    return rows.withColumn("__best", F.min("tier").over(Window.partitionBy("page_id"))).filter("tier = __best").drop("__best")


def top_years_per_company(plan: DataFrame, years: int = 3) -> DataFrame:
    """The latest target years of each id."""
    last = Window.partitionBy("cin").orderBy(F.col("target_fy").desc())
    return plan.select("cin", "target_fy").distinct().withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= years).drop("__n")


def cleaned_list(df: DataFrame, name: str = "company_name", cin: str = "cin", row: str = "source_row") -> DataFrame:
    """A company list as (company_name, cin, source_row): names trimmed, blank ones dropped, ids normalised."""
    rows = df.select(normalize_text(F.col(name)).alias("company_name"), normalize_cin(F.col(cin)).alias("cin"), F.col(row).cast("long").alias("source_row"))
    return rows.filter("company_name <> ''")
