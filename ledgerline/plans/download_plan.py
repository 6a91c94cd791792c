"""The filing-collection plan: anchor years, look-back years, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_listed, normalize_cin, parse_year

#: Plan settings: fixed values.
FALLBACK_YEAR = 2023
LOOKBACK = 3
REQUIRED = ("annual_report", "balance_sheet", "profit_and_loss", "cash_flow", "auditor_report", "notes_to_accounts")
OPTIONAL = ("director_report", "related_party_transactions", "charges")
SECTOR_ALIASES = {
    "FMCG / Foods": "FMCG / Foods / Agro",
    "Travel / Hospitality": "Travel / Aviation / Hospitality",
    "Travel / Aviation": "Travel / Aviation / Hospitality",
    "IT / Services": "IT / Services / Export",
    "Oil & Gas": "Oil & Gas / Energy",
}
FALLBACK_REASON = "fallback_default_anchor_fy"


def defaulter_anchor(df: DataFrame, mode: str = "default", fallback: int = FALLBACK_YEAR, offset: int = -1, fixed: int | None = None, column: str = "anchor_fy") -> DataFrame:
    """df with anchor_fy and anchor_reason: the year before default, else the default year with an offset, else a fallback."""
    def made(*choices: tuple[Column, str]) -> DataFrame:
        year, reason = F.lit(fallback), F.lit(FALLBACK_REASON)
        for value, name in reversed(choices):
            year, reason = F.when(value.isNotNull(), value).otherwise(year), F.when(value.isNotNull(), F.lit(name)).otherwise(reason)
        return df.withColumns({"anchor_fy": year.cast("int"), "anchor_reason": reason})

    if mode == "fixed_year":
        return made((F.lit(fixed).cast("int"), "fixed_year"))
    if mode == "column":
        return made((parse_year(F.col(column)), column))
    return made((parse_year(F.col("fy_before_default")), "fy_before_default"), (parse_year(F.col("default_year")) + offset, f"default_year{offset:+d}"))


def median_anchor(df: DataFrame, key: str | None, column: str = "anchor_fy", fallback: int = FALLBACK_YEAR) -> DataFrame:
    """Median year by key, or over all rows without one, rounded half to even."""
    median = F.coalesce(F.bround(F.percentile(column, F.lit(0.5)), 0).cast("int"), F.lit(fallback)).alias("median_anchor")
    return df.groupBy(key).agg(median) if key else df.agg(median)


def control_anchor(controls: DataFrame, defaulters: DataFrame, aliases: dict[str, str] = SECTOR_ALIASES, fallback: int = FALLBACK_YEAR) -> DataFrame:
    """controls with the median anchor of their sector's defaulters, else that of all defaulters."""
    by_sector = median_anchor(defaulters.filter(F.trim("sector") != ""), "sector", fallback=fallback).withColumnsRenamed({"sector": "__sector", "median_anchor": "__median"})
    overall = median_anchor(defaulters, None, fallback=fallback).withColumnRenamed("median_anchor", "__overall")
    raw = F.trim(F.coalesce(F.col("sector"), F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    rows = controls.withColumn("__alias", F.coalesce(F.try_element_at(known, raw), raw))
    rows = rows.join(by_sector, F.col("__alias") == F.col("__sector"), "left").join(F.broadcast(overall))  # one row
    found = F.col("__median").isNotNull()
    rows = rows.withColumns({
        "anchor_fy": F.coalesce("__median", "__overall"),
        "anchor_reason": F.when(found, "sector_median_from_defaulters").otherwise("global_median_from_defaulters"),
    })
    return rows.drop("__alias", "__sector", "__median", "__overall")


def lookback_years(df: DataFrame, years: int = LOOKBACK, ascending: bool = False) -> DataFrame:
    """A row for each of the years up to the anchor."""
    span = F.sequence(F.col("anchor_fy"), F.col("anchor_fy") - (years - 1), F.lit(-1))
    return df.withColumn("target_fy", F.explode(F.reverse(span) if ascending else span))


def expand_documents(df: DataFrame) -> DataFrame:
    """A row for each document of a year, required or not."""
    docs = F.array(*[F.struct(F.lit(d).alias("doc_type"), F.lit(d in REQUIRED).alias("required")) for d in (*REQUIRED, *OPTIONAL)])
    return df.withColumn("__doc", F.explode(docs)).select("*", "__doc.doc_type", "__doc.required").drop("__doc")


def source_priority(listed: Column) -> Column:
    return F.when(listed, "bse|nse|mca").otherwise("mca")


PLAN_COLUMNS = ["cohort", "company_name", "cin", "sector", "is_listed", "anchor_fy", "anchor_reason", "source_priority", "target_fy", "doc_type", "required"]


def download_plan(defaulters: DataFrame, controls: DataFrame, years: int = LOOKBACK) -> DataFrame:
    """The whole plan, unordered; rows are narrowed before they are multiplied."""
    columns = ["cohort", "company_name", "cin", "sector", "anchor_fy", "anchor_reason"]
    anchored = defaulter_anchor(defaulters).withColumn("cohort", F.lit("defaulter")).select(*columns)
    others = control_anchor(controls, anchored).withColumn("cohort", F.lit("non_defaulter")).select(*columns)
    rows = anchored.unionByName(others).withColumn("cin", normalize_cin(F.col("cin")))
    rows = rows.withColumn("is_listed", is_listed(F.col("cin"))).withColumn("source_priority", source_priority(F.col("is_listed")))
    return expand_documents(lookback_years(rows, years)).select(*PLAN_COLUMNS)


def ordered_plan(plan: DataFrame) -> DataFrame:
    return plan.orderBy("cohort", "company_name", "target_fy", F.col("required").desc(), "doc_type")


def plan_summary(plan: DataFrame) -> DataFrame:
    """(metric, value): companies, company-years, documents required and optional, rows by cohort and by source."""
    totals = plan.agg(
        F.countDistinct("cin").alias("companies"),
        F.countDistinct("cin", "target_fy").alias("company_years"),
        F.count_if(F.col("required")).alias("required_documents"),
        F.count_if(~F.col("required")).alias("optional_documents"),
    )
    names = totals.columns
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    by = lambda c: plan.groupBy(F.concat(F.lit(f"{c}:"), F.col(c)).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return long.unionByName(by("cohort")).unionByName(by("source_priority"))
