"""Row-level features of company-years, in one projection, and temporal ones, over one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cin_incorporation_year, normalize_text, safe_divide, safe_positive_divide

#: Opinions that count as a qualification: fixed values.
ADVERSE_OPINIONS = ("qualified", "adverse", "disclaimer")
FLAGS = ("going_concern_uncertainty", "emphasis_of_matter", "fraud_reported")
MISSING_NUMERIC = ("current_assets", "current_liabilities", "receivables", "capex", "contingent_liabilities_amount", "promoter_holding_pct")
MISSING_TEXT = ("opinion_type", "auditor_name")
YOY_NORMALIZED = ("revenue", "pat", "ebitda", "total_borrowings", "cfo")
YOY_DIFFERENCE = ("current_ratio", "debt_to_equity", "net_profit_margin", "roa", "promoter_holding_pct")
TEMPORAL = (*YOY_NORMALIZED, *YOY_DIFFERENCE)


def base_amounts() -> dict[str, Column]:
    c = F.col
    ebit = c("pat") + c("interest_expense") + c("tax_expense")
    capex = F.coalesce(F.abs("capex"), F.abs("cfi"))
    return {
        "target_wilful_default": (normalize_text(c("cohort")) == "defaulter").cast("int"),
        "incorporation_year": cin_incorporation_year(c("cin")),
        "company_age": c("financial_year") - cin_incorporation_year(c("cin")),
        "ebit": ebit,
        "ebitda": F.coalesce("ebitda", ebit + c("depreciation")),
        "working_capital": c("current_assets") - c("current_liabilities"),
        "total_liabilities_proxy": c("total_assets") - c("total_equity"),
        "capex_effective": capex,
        "free_cash_flow": c("cfo") - capex,
    }


def ratios() -> dict[str, Column]:
    """Ratios over the base amounts: every one null where its denominator is null or 0, some where it is not above 0."""
    c = F.col
    over = lambda n, d: safe_divide(c(n), c(d))
    positive = lambda n, d: safe_positive_divide(c(n), c(d))
    return {
        "current_ratio": over("current_assets", "current_liabilities"),
        "quick_ratio": safe_divide(c("current_assets") - c("inventory"), c("current_liabilities")),
        "cash_ratio": over("cash_and_equivalents", "current_liabilities"),
        "debt_to_equity": positive("total_borrowings", "total_equity"),
        "debt_to_assets": over("total_borrowings", "total_assets"),
        "interest_coverage": over("ebit", "interest_expense"),
        "debt_service_coverage_proxy": over("cfo", "interest_expense"),
        "net_profit_margin": over("pat", "revenue"),
        "ebitda_margin": over("ebitda", "revenue"),
        "roa": over("pat", "total_assets"),
        "roe": positive("pat", "total_equity"),
        "asset_turnover": over("revenue", "total_assets"),
        "receivables_turnover": over("revenue", "receivables"),
        "cfo_margin": over("cfo", "revenue"),
        "cash_flow_to_debt": over("cfo", "total_borrowings"),
        "working_capital_to_assets": over("working_capital", "total_assets"),
        "retained_earnings_to_assets": over("retained_earnings", "total_assets"),
        "ebit_to_assets": over("ebit", "total_assets"),
        "equity_ratio": over("total_equity", "total_assets"),
        "current_liabilities_to_assets": over("current_liabilities", "total_assets"),
        "rpt_to_revenue_ratio": over("related_party_transactions_amount", "revenue"),
        "contingent_to_networth_ratio": positive("contingent_liabilities_amount", "total_equity"),
    }


def audit_flags() -> dict[str, Column]:
    c, zero = F.col, F.lit(0.0)
    above = lambda x: (F.coalesce(x, zero) > 0).cast("int")
    amount, count, contingent = c("related_party_transactions_amount"), c("rpt_count"), c("contingent_liabilities_amount")
    out = {
        "auditor_qualification_flag": F.lower(normalize_text(c("opinion_type"))).isin(*ADVERSE_OPINIONS).cast("int"),
        "opinion_present_flag": (normalize_text(c("opinion_type")) != "").cast("int"),
        "auditor_name_present_flag": (normalize_text(c("auditor_name")) != "").cast("int"),
    }
    for f in FLAGS:
        out[f"{f}_unknown"] = c(f).isNull().cast("int")
        out[f"{f}_flag"] = above(c(f))
    return out | {
        "related_party_unknown": (amount.isNull() & count.isNull()).cast("int"),
        "related_party_flag": ((F.coalesce(amount, zero) > 0) | (F.coalesce(count, zero) > 0)).cast("int"),
        "contingent_liability_unknown": contingent.isNull().cast("int"),
        "contingent_liability_flag": above(contingent),
    }


def missing_flags() -> dict[str, Column]:
    return {f"{x}_missing": F.col(x).isNull().cast("int") for x in MISSING_NUMERIC} | {f"{x}_missing": (normalize_text(F.col(x)) == "").cast("int") for x in MISSING_TEXT}


def altman_z() -> Column:
    """The Z proxy; a missing term counts as 0."""
    term = lambda weight, x: F.lit(weight) * F.coalesce(x, F.lit(0.0))
    solvency = safe_positive_divide(F.col("total_equity"), F.col("total_liabilities_proxy"))
    return (
        term(1.2, F.col("working_capital_to_assets")) + term(1.4, F.col("retained_earnings_to_assets")) + term(3.3, F.col("ebit_to_assets"))
        + term(0.6, solvency) + term(1.0, F.col("asset_turnover"))
    )


def add_row_features(df: DataFrame) -> DataFrame:
    """df with all 52 row-level features; no shuffle."""
    return df.withColumns(base_amounts()).withColumns(ratios() | audit_flags() | missing_flags()).withColumn("altman_z_proxy", altman_z())


def company_windows(company_key: list[str], tie: str = "cin"):
    everything = Window.partitionBy(*company_key)
    return everything.orderBy("financial_year", tie), everything


def yoy(df: DataFrame, columns: list[str], kind: str, company_key: list[str]) -> DataFrame:
    """Change against the company's previous row: relative to its size ("normalized") or plain ("difference")."""
    ordered, _ = company_windows(company_key)
    made = {}
    for x in columns:
        before = F.lag(x).over(ordered)
        change = F.col(x) - before
        made[f"{x}_yoy"] = F.try_divide(change, F.abs(before)) if kind == "normalized" else change
    return df.withColumns(made)


def trend_slope(df: DataFrame, columns: list[str], company_key: list[str], min_points: int = 2, as_of: bool = False) -> DataFrame:
    """Least-squares slope on the year over the company's rows, or over those up to the row's own with as_of."""
    ordered, frame = company_windows(company_key)
    if as_of:
        frame = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{x}_trend_3y": F.when(F.count(x).over(frame) >= min_points, F.regr_slope(F.col(x), F.col("financial_year")).over(frame)) for x in columns})


def volatility(df: DataFrame, columns: list[str], company_key: list[str], min_points: int = 2, as_of: bool = False) -> DataFrame:
    """Population standard deviation over the company's rows; null below min_points values."""
    ordered, frame = company_windows(company_key)
    if as_of:
        frame = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{x}_volatility_3y": F.when(F.count(x).over(frame) >= min_points, F.stddev_pop(x).over(frame)) for x in columns})


def auditor_changed(df: DataFrame, company_key: list[str]) -> DataFrame:
    """auditor_changed_yoy: 1.0 where this and the previous row name different auditors, else 0.0; and the company's maximum."""
    ordered, everything = company_windows(company_key)
    name = normalize_text(F.col("auditor_name"))
    before = F.lag(name).over(ordered)
    df = df.withColumn("auditor_changed_yoy", F.when((name != "") & (before != "") & (name != before), 1.0).otherwise(0.0))
    return df.withColumn("auditor_changed_3y", F.max("auditor_changed_yoy").over(everything))


def relative_year(df: DataFrame, company_key: list[str]) -> DataFrame:
    _, everything = company_windows(company_key)
    last = F.max("financial_year").over(everything)
    return df.withColumns({"relative_year_from_latest": F.col("financial_year") - last, "is_latest_observation": (F.col("financial_year") == last).cast("int")})


def add_temporal_features(df: DataFrame, company_key: list[str] = ["company_name"]) -> DataFrame:  # noqa: B006
    """df with the 34 temporal features; all windows share one exchange by the company and one sort."""
    df = yoy(df, list(YOY_NORMALIZED), "normalized", company_key)
    df = yoy(df, list(YOY_DIFFERENCE), "difference", company_key)
    df = relative_year(df, company_key)
    df = volatility(trend_slope(df, list(TEMPORAL), company_key), list(TEMPORAL), company_key)
    return auditor_changed(df, company_key)


def build_features(df: DataFrame, company_key: list[str] = ["company_name"]) -> DataFrame:  # noqa: B006
    """Raw company-years with all 86 features."""
    return add_temporal_features(add_row_features(df), company_key)


def yoy_lag2(df: DataFrame, columns: list[str], company_key: list[str]) -> DataFrame:
    """Differences of this row against the previous, and of the previous against the one before it."""
    ordered, _ = company_windows(company_key)
    made = {}
    for x in columns:
        made[f"{x}_yoy_1y"] = F.col(x) - F.lag(x, 1).over(ordered)
        made[f"{x}_yoy_2y"] = F.lag(x, 1).over(ordered) - F.lag(x, 2).over(ordered)
    return df.withColumns(made)


def warning_streaks(df: DataFrame, condition: Column, company_key: list[str], least: int = 2) -> DataFrame:
    """Per company, the longest run of consecutive years in which the condition holds, and whether it reaches `least`."""
    ordered, _ = company_windows(company_key)
    hits = df.filter(F.coalesce(condition, F.lit(False))).select(*company_key, "financial_year", "cin")
    runs = hits.withColumn("run", F.col("financial_year") - F.row_number().over(ordered))
    lengths = runs.groupBy(*company_key, "run").agg(F.count(F.lit(1)).alias("years"))
    longest = lengths.groupBy(*company_key).agg(F.max("years").alias("longest_streak"))
    return longest.withColumn("warning", F.col("longest_streak") >= least)


def forward_fill(df: DataFrame, columns: list[str], company_key: list[str]) -> DataFrame:
    """Missing values filled with the company's last known one."""
    ordered, _ = company_windows(company_key)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{x}_filled": F.last(x, ignorenulls=True).over(upto) for x in columns})


def spec_features(df: DataFrame, company_key: list[str]) -> DataFrame:
    """Features that only the written specification names."""
    ordered, _ = company_windows(company_key)
    before = F.lag("revenue").over(ordered)
    c = F.col
    return df.withColumns({
        "cfo_to_pat": safe_positive_divide(c("cfo"), c("pat")),
        "cfo_pct_revenue": safe_divide(c("cfo"), c("revenue")) * 100,
        "revenue_growth_pct": F.try_divide(c("revenue") - before, before) * 100,
        "promoter_holding_change_yoy": c("promoter_holding_pct") - F.lag("promoter_holding_pct").over(ordered),
        "receivables_turnover_strict": safe_positive_divide(c("revenue"), c("receivables")),
        "distress_zone": F.coalesce(c("altman_z_proxy") < 1.8, F.lit(False)),
    })
