"""Queries of row-level and temporal features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import quality, rules, scoring, selection
from . import panel
from .catalog import query

ID = ["cin", "company_name", "financial_year"]
IDS = ", ".join(ID)


def over(n: str, d: str) -> str:
    return f"({n}) / nullif({d}, 0)"


def positive(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({n}) / {d} END"


RATIO_SQL = {
    "current_ratio": over("current_assets", "current_liabilities"),
    "quick_ratio": over("current_assets - inventory", "current_liabilities"),
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
FLAG_SQL = {
    "auditor_qualification_flag": "(lower(trim(coalesce(opinion_type, ''))) IN ('qualified', 'adverse', 'disclaimer'))::INT",
    "opinion_present_flag": "(trim(coalesce(opinion_type, '')) <> '')::INT",
    "auditor_name_present_flag": "(trim(coalesce(auditor_name, '')) <> '')::INT",
    "going_concern_uncertainty_unknown": "(going_concern_uncertainty IS NULL)::INT",
    "going_concern_uncertainty_flag": "(coalesce(going_concern_uncertainty, 0) > 0)::INT",
    "emphasis_of_matter_unknown": "(emphasis_of_matter IS NULL)::INT",
    "emphasis_of_matter_flag": "(coalesce(emphasis_of_matter, 0) > 0)::INT",
    "fraud_reported_unknown": "(fraud_reported IS NULL)::INT",
    "fraud_reported_flag": "(coalesce(fraud_reported, 0) > 0)::INT",
    "related_party_unknown": "(related_party_transactions_amount IS NULL AND rpt_count IS NULL)::INT",
    "related_party_flag": "(coalesce(related_party_transactions_amount, 0) > 0 OR coalesce(rpt_count, 0) > 0)::INT",
    "contingent_liability_unknown": "(contingent_liabilities_amount IS NULL)::INT",
    "contingent_liability_flag": "(coalesce(contingent_liabilities_amount, 0) > 0)::INT",
}
MISSING_SQL = {f"{c}_missing": f"({c} IS NULL)::INT" for c in ft.MISSING_NUMERIC} | {f"{c}_missing": f"(trim(coalesce({c}, '')) = '')::INT" for c in ft.MISSING_TEXT}
ALTMAN_SQL = (
    "1.2::DOUBLE * coalesce(working_capital_to_assets, 0) + 1.4::DOUBLE * coalesce(retained_earnings_to_assets, 0) + 3.3::DOUBLE * coalesce(ebit_to_assets, 0) "
    "+ 0.6::DOUBLE * coalesce(CASE WHEN total_liabilities_proxy > 0 THEN total_equity / total_liabilities_proxy END, 0) + 1.0::DOUBLE * coalesce(asset_turnover, 0)"
)
YEAR_SQL = "CASE WHEN regexp_matches(upper(trim(cin)), '^[A-Z][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$') AND substr(upper(trim(cin)), 9, 4)::INT BETWEEN 1900 AND 2100 THEN substr(upper(trim(cin)), 9, 4)::INT END"
cols = lambda d: ", ".join(f"{v} AS {k}" for k, v in d.items())
FEATURES_SQL = f"""{panel.SQL},
base AS (
  SELECT * REPLACE (coalesce(ebitda, pat + interest_expense + tax_expense + depreciation) AS ebitda),
    (trim(cohort) = 'defaulter')::INT AS target_wilful_default, {YEAR_SQL} AS incorporation_year, financial_year - {YEAR_SQL} AS company_age,
    pat + interest_expense + tax_expense AS ebit, current_assets - current_liabilities AS working_capital,
    total_assets - total_equity AS total_liabilities_proxy, coalesce(abs(capex), abs(cfi)) AS capex_effective,
    cfo - coalesce(abs(capex), abs(cfi)) AS free_cash_flow
  FROM company_year),
ratioed AS (SELECT *, {cols(RATIO_SQL)}, {cols(FLAG_SQL)}, {cols(MISSING_SQL)} FROM base),
row_features AS (SELECT *, {ALTMAN_SQL} AS altman_z_proxy FROM ratioed)
"""


def slope_sql(c: str, frame: str = "u", least: int = 2) -> str:
    slope = f"regr_slope({c}, financial_year) OVER {frame}"
    return f"CASE WHEN count({c}) OVER {frame} >= {least} AND NOT isnan({slope}) THEN {slope} END"


def spread_sql(c: str, frame: str = "u", least: int = 2) -> str:
    return f"CASE WHEN count({c}) OVER {frame} >= {least} THEN stddev_pop({c}) OVER {frame} END"


YOY_SQL = {f"{c}_yoy": f"({c} - lag({c}) OVER w) / nullif(abs(lag({c}) OVER w), 0)" for c in ft.YOY_NORMALIZED} | {f"{c}_yoy": f"{c} - lag({c}) OVER w" for c in ft.YOY_DIFFERENCE}
TREND_SQL = {f"{c}_trend_3y": slope_sql(c) for c in ft.TEMPORAL}
SPREAD_SQL = {f"{c}_volatility_3y": spread_sql(c) for c in ft.TEMPORAL}
CHANGED_SQL = "CASE WHEN trim(coalesce(auditor_name, '')) <> '' AND lag(trim(coalesce(auditor_name, ''))) OVER w <> '' AND trim(coalesce(auditor_name, '')) <> lag(trim(coalesce(auditor_name, ''))) OVER w THEN 1.0 ELSE 0.0 END"
TEMPORAL_SQL = f"""{FEATURES_SQL},
moved AS (
  SELECT *, {cols(YOY_SQL)}, {cols(TREND_SQL)}, {cols(SPREAD_SQL)}, ({CHANGED_SQL})::DOUBLE AS auditor_changed_yoy,
    financial_year - max(financial_year) OVER u AS relative_year_from_latest, (financial_year = max(financial_year) OVER u)::INT AS is_latest_observation
  FROM row_features WINDOW w AS (PARTITION BY company_name ORDER BY financial_year, cin), u AS (PARTITION BY company_name)),
features AS (SELECT *, max(auditor_changed_yoy) OVER (PARTITION BY company_name) AS auditor_changed_3y FROM moved)
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.add_row_features(panel.company_years(spark, sf_dir))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.build_features(panel.company_years(spark, sf_dir))


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"WITH {panel.SQL} SELECT * FROM company_year")
def company_year_panel(spark, sf_dir):
    return panel.company_years(spark, sf_dir)


GROUPS = {
    "base_amounts": ["target_wilful_default", "incorporation_year", "company_age", "ebit", "ebitda", "working_capital", "total_liabilities_proxy", "capex_effective", "free_cash_flow"],
    "liquidity_ratios": ["current_ratio", "quick_ratio", "cash_ratio"],
    "leverage_ratios": ["debt_to_equity", "debt_to_assets", "interest_coverage", "debt_service_coverage_proxy"],
    "profitability_ratios": ["net_profit_margin", "ebitda_margin", "roa", "roe"],
    "efficiency_ratios": ["asset_turnover", "receivables_turnover"],
    "cashflow_ratios": ["cfo_margin", "cash_flow_to_debt"],
    "asset_scaled_ratios": ["working_capital_to_assets", "retained_earnings_to_assets", "ebit_to_assets", "equity_ratio", "current_liabilities_to_assets"],
    "governance_ratios": ["rpt_to_revenue_ratio", "contingent_to_networth_ratio"],
    "audit_flags": list(FLAG_SQL),
    "missing_flags": list(MISSING_SQL),
    "altman_z": ["altman_z_proxy"],
}


def _group(name: str, names: list[str]) -> None:
    def run(spark, sf_dir):
        return rows(spark, sf_dir).select(*ID, *names)

    run.__name__ = name
    run.__doc__ = f"Company-years with {', '.join(names)}."
    query(f"WITH {FEATURES_SQL} SELECT {IDS}, {', '.join(names)} FROM row_features")(run)


for _name, _names in GROUPS.items():
    _group(_name, _names)


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, {', '.join(f'{c}_yoy' for c in ft.YOY_NORMALIZED)} FROM features")
def yoy_normalized(spark, sf_dir):
    return ft.yoy(rows(spark, sf_dir), list(ft.YOY_NORMALIZED), "normalized", ["company_name"]).select(*ID, *[f"{c}_yoy" for c in ft.YOY_NORMALIZED])


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, {', '.join(f'{c}_yoy' for c in ft.YOY_DIFFERENCE)} FROM features")
def yoy_difference(spark, sf_dir):
    return ft.yoy(rows(spark, sf_dir), list(ft.YOY_DIFFERENCE), "difference", ["company_name"]).select(*ID, *[f"{c}_yoy" for c in ft.YOY_DIFFERENCE])


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, {', '.join(f'round({c}_trend_3y, 7) AS {c}_trend_3y' for c in ft.TEMPORAL)} FROM features")
def trend_slope(spark, sf_dir):
    names = [f"{c}_trend_3y" for c in ft.TEMPORAL]
    return rounded(ft.trend_slope(rows(spark, sf_dir), list(ft.TEMPORAL), ["company_name"]).select(*ID, *names), dict.fromkeys(names, 7))


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, {', '.join(f'round({c}_volatility_3y, 7) AS {c}_volatility_3y' for c in ft.TEMPORAL)} FROM features")
def volatility(spark, sf_dir):
    names = [f"{c}_volatility_3y" for c in ft.TEMPORAL]
    return rounded(ft.volatility(rows(spark, sf_dir), list(ft.TEMPORAL), ["company_name"]).select(*ID, *names), dict.fromkeys(names, 7))


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, auditor_changed_yoy FROM features")
def auditor_changed_yoy(spark, sf_dir):
    return ft.auditor_changed(panel.company_years(spark, sf_dir), ["company_name"]).select(*ID, "auditor_changed_yoy")


@query(f"WITH {TEMPORAL_SQL} SELECT company_name, max(auditor_changed_3y) AS auditor_changed_3y FROM features GROUP BY 1")
def auditor_changed_ever(spark, sf_dir):
    return ft.auditor_changed(panel.company_years(spark, sf_dir), ["company_name"]).groupBy("company_name").agg(F.max("auditor_changed_3y").alias("auditor_changed_3y"))


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, relative_year_from_latest, is_latest_observation FROM features")
def relative_year(spark, sf_dir):
    return ft.relative_year(panel.company_years(spark, sf_dir), ["company_name"]).select(*ID, "relative_year_from_latest", "is_latest_observation")


@query(f"""WITH {FEATURES_SQL} SELECT {IDS}, {', '.join(f'{c} - lag({c}) OVER w AS {c}_yoy_1y, lag({c}) OVER w - lag({c}, 2) OVER w AS {c}_yoy_2y' for c in ('current_ratio', 'roa'))}
FROM row_features WINDOW w AS (PARTITION BY company_name ORDER BY financial_year, cin)""")
def yoy_lag2(spark, sf_dir):
    return ft.yoy_lag2(rows(spark, sf_dir), ["current_ratio", "roa"], ["company_name"]).select(*ID, *[f"{c}_yoy_{n}y" for c in ("current_ratio", "roa") for n in (1, 2)])


@query(f"""WITH {FEATURES_SQL} SELECT {IDS}, round({slope_sql('roa', least=3)}, 7) AS roa_trend_3y, round({slope_sql('revenue', 'w')}, 7) AS revenue_trend_as_of
FROM row_features WINDOW u AS (PARTITION BY company_name), w AS (PARTITION BY company_name ORDER BY financial_year, cin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def strict_trend(spark, sf_dir):
    df = ft.trend_slope(rows(spark, sf_dir), ["roa"], ["company_name"], min_points=3)
    df = ft.trend_slope(df, ["revenue"], ["company_name"], as_of=True).withColumnRenamed("revenue_trend_3y", "revenue_trend_as_of")
    return rounded(df.select(*ID, "roa_trend_3y", "revenue_trend_as_of"), {"roa_trend_3y": 7, "revenue_trend_as_of": 7})


@query(f"""WITH {FEATURES_SQL}, hits AS (SELECT company_name, financial_year - row_number() OVER (PARTITION BY company_name ORDER BY financial_year, cin) AS run FROM row_features WHERE interest_coverage < 1.5),
runs AS (SELECT company_name, run, count(*) AS n FROM hits GROUP BY ALL) SELECT company_name, max(n) AS longest_streak, max(n) >= 2 AS warning FROM runs GROUP BY 1""")
def warning_streaks(spark, sf_dir):
    return ft.warning_streaks(rows(spark, sf_dir), F.col("interest_coverage") < 1.5, ["company_name"])


@query(f"""WITH {FEATURES_SQL} SELECT {IDS}, last_value(capex IGNORE NULLS) OVER w AS capex_filled, last_value(receivables IGNORE NULLS) OVER w AS receivables_filled
FROM row_features WINDOW w AS (PARTITION BY company_name ORDER BY financial_year, cin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill(spark, sf_dir):
    return ft.forward_fill(panel.company_years(spark, sf_dir), ["capex", "receivables"], ["company_name"]).select(*ID, "capex_filled", "receivables_filled")


@query(f"""WITH {FEATURES_SQL} SELECT {IDS}, {positive('cfo', 'pat')} AS cfo_to_pat, {over('cfo', 'revenue')} * 100 AS cfo_pct_revenue,
  (revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0) * 100 AS revenue_growth_pct, promoter_holding_pct - lag(promoter_holding_pct) OVER w AS promoter_holding_change_yoy,
  {positive('revenue', 'receivables')} AS receivables_turnover_strict, coalesce(altman_z_proxy < 1.8, false) AS distress_zone
FROM row_features WINDOW w AS (PARTITION BY company_name ORDER BY financial_year, cin)""")
def spec_features(spark, sf_dir):
    return ft.spec_features(rows(spark, sf_dir), ["company_name"]).select(*ID, "cfo_to_pat", "cfo_pct_revenue", "revenue_growth_pct", "promoter_holding_change_yoy", "receivables_turnover_strict", "distress_zone")


ID_LABEL = ["company_name", "cin", "financial_year", "target_wilful_default"]
EXCLUDED = ["cohort", "incorporation_year", "capex_effective", "relative_year_from_latest", "is_latest_observation"]
TRAIN_SQL = "sector, revenue, pat, current_ratio, debt_to_equity, interest_coverage, net_profit_margin, revenue_yoy, pat_yoy"


@query(f"WITH {TEMPORAL_SQL} SELECT company_name, cin, financial_year, target_wilful_default, {TRAIN_SQL} FROM features")
def select_training_columns(spark, sf_dir):
    df = selection.select_training_columns(full(spark, sf_dir), ID_LABEL[:3], ID_LABEL[3], EXCLUDED, panel.TEXT)
    return df.select(*ID_LABEL, *TRAIN_SQL.split(", "))


@query(f"WITH {panel.SQL} SELECT revenue, pat, NULL::DOUBLE AS gross_margin, NULL::DOUBLE AS beta FROM company_year")
def align_model_input(spark, sf_dir):
    df = scoring.ensure_schema(panel.company_years(spark, sf_dir), {"gross_margin": "double"})
    return scoring.align_model_input(df, ["revenue", "pat", "gross_margin", "beta"])


@query(f"WITH {FEATURES_SQL} SELECT cohort, avg(debt_to_equity) AS avg_debt_to_equity, 100 * avg(auditor_qualification_flag) AS qualified_pct, 100 * avg(rpt_to_revenue_ratio) AS avg_rpt_pct_revenue, count(*) AS n_rows FROM row_features GROUP BY 1".replace("avg(debt_to_equity)", "round(avg(debt_to_equity), 4)").replace("100 * avg(auditor_qualification_flag)", "round(100 * avg(auditor_qualification_flag), 4)").replace("100 * avg(rpt_to_revenue_ratio)", "round(100 * avg(rpt_to_revenue_ratio), 4)"))
def cohort_comparison(spark, sf_dir):
    return rounded(quality.cohort_comparison(rows(spark, sf_dir)), {"avg_debt_to_equity": 4, "qualified_pct": 4, "avg_rpt_pct_revenue": 4})


def rule_sql(c) -> str:
    if c[0] in ("all", "any"):
        return "(" + (" AND " if c[0] == "all" else " OR ").join(rule_sql(x) for x in c[1]) + ")"
    return f"coalesce({c[0]} {dict(lt='<', gt='>', eq='=')[c[1]]} {c[2]}, false)"


NAMES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {rule_sql(c)} THEN '{n}' END" for n, _, c, _ in rules.RULES) + "], lambda x: x IS NOT NULL)"
CRITICAL_SQL = reduce(lambda a, b: f"{a} + {b}", [f"({rule_sql(c)})::INT" for _, s, c, _ in rules.RULES if s == "critical"])


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, array_to_string({NAMES_SQL}, '|') AS flags, len({NAMES_SQL})::INT AS n_flags, ({CRITICAL_SQL})::INT AS n_critical FROM features")
def evaluate_rules(spark, sf_dir):
    df = full(spark, sf_dir).withColumn("t", rules.rule_flags())
    critical = F.size(F.filter("t", lambda x: x["severity"] == "critical"))
    return df.select(*ID, F.array_join(F.transform("t", lambda x: x["name"]), "|").alias("flags"), F.size("t").alias("n_flags"), critical.alias("n_critical"))


@query(f"""WITH {TEMPORAL_SQL} SELECT company_name, cin, sector, financial_year, array_to_string({NAMES_SQL}, '|') AS flags, len({NAMES_SQL})::INT AS n_flags,
  round(revenue_trend_3y, 7) AS revenue_trend_3y, round(cfo_trend_3y, 7) AS cfo_trend_3y, round(total_borrowings_trend_3y, 7) AS total_borrowings_trend_3y
FROM features WHERE is_latest_observation = 1""")
def risk_flags_latest(spark, sf_dir):
    """The flagship: each company's red flags in its latest year, and its trends."""
    df = full(spark, sf_dir).filter("is_latest_observation = 1").withColumn("t", rules.rule_flags())
    df = df.select("company_name", "cin", "sector", "financial_year", F.array_join(F.transform("t", lambda x: x["name"]), "|").alias("flags"), F.size("t").alias("n_flags"), "revenue_trend_3y", "cfo_trend_3y", "total_borrowings_trend_3y")
    return rounded(df, dict.fromkeys(["revenue_trend_3y", "cfo_trend_3y", "total_borrowings_trend_3y"], 7))
