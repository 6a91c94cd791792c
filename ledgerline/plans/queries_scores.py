"""Queries of scoring: probability, reasons, bands, roll-up, warnings and the flat output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, scoring
from ..operators.features import build_features
from ..operators.ranges import stored
from . import panel
from .catalog import query
from .queries_features import CRITICAL_SQL, FEATURES_SQL, ID, IDS, NAMES_SQL, TEMPORAL_SQL, full, rows

THRESHOLD = 0.5
P_SQL = "1 / (1 + exp(-(-0.5::DOUBLE + 0.4::DOUBLE * least(coalesce(debt_to_equity, 1.0), 5.0) - 2.0::DOUBLE * coalesce(net_profit_margin, 0.0))))"
quoted = lambda x: "'" + x.replace("'", "''") + "'"
REF_SQL = "ref AS (SELECT sector AS ref_sector, " + ", ".join(f"median({f}) AS m_{f}" for f in scoring.PEER_FEATURES) + " FROM features GROUP BY 1)"
PEER_SQL = "list_filter([" + ", ".join(f"CASE WHEN {f} {'>' if worse else '<'} m_{f} THEN {quoted(label)} END" for f, (worse, label) in scoring.PEER_FEATURES.items()) + "], lambda x: x IS NOT NULL)[1:3]"
REASON_SQL = "list_filter([" + ", ".join(f"CASE WHEN list_contains(names, '{n}') THEN {quoted(r)} END" for n, _, _, r in rules.RULES) + "], lambda x: x IS NOT NULL)"
MISSING_SQL = " + ".join(f"({c} IS NULL)::INT" for c in scoring.MODEL_INPUTS)
DECIDED_SQL = f"""{TEMPORAL_SQL}, {REF_SQL},
p AS (SELECT f.*, {P_SQL} AS p, {NAMES_SQL} AS names, ({CRITICAL_SQL})::INT AS n_critical, {PEER_SQL} AS peers, ({MISSING_SQL}) / {float(len(scoring.MODEL_INPUTS))}::DOUBLE AS imputed FROM features f LEFT JOIN ref ON sector = ref_sector),
b AS (SELECT *, len(names)::INT AS n_flags, CASE WHEN p >= 0.5 THEN 'High' WHEN p >= 0.35 THEN 'Medium' ELSE 'Low' END AS base, {REASON_SQL} AS reasons FROM p),
decided AS (
  SELECT *, CASE WHEN n_flags >= 2 AND n_critical >= 1 THEN CASE base WHEN 'Low' THEN 'Medium' ELSE 'High' END ELSE base END AS risk_band,
    list_concat(reasons, peers)[1:3] AS top
  FROM b)"""


def stored_features(spark, sf_dir):
    """All features over company-years that are stored, for the medians and for the rows that meet them."""
    return build_features(stored(panel.company_years(spark, sf_dir), "company-years"))


def decided(spark, sf_dir):
    return scoring.score_years(stored_features(spark, sf_dir), THRESHOLD)


@query(f"WITH {DECIDED_SQL} SELECT {IDS}, round(p, 9) AS ml_probability, (p >= 0.5)::INT AS ml_class, n_flags AS rule_flag_count, n_critical AS critical_rule_count, risk_band, array_to_string(top, ' | ') AS top_reasons FROM decided")
def hybrid_decision(spark, sf_dir):
    return decided(spark, sf_dir).select(*ID, F.round("ml_probability", 9).alias("ml_probability"), "ml_class", "rule_flag_count", "critical_rule_count", "risk_band", F.array_join("top_reasons", " | ").alias("top_reasons"))


@query(f"WITH {FEATURES_SQL} SELECT {IDS}, CASE WHEN {P_SQL} >= 0.5 THEN 'High' WHEN {P_SQL} >= 0.35 THEN 'Medium' ELSE 'Low' END AS band FROM row_features")
def base_risk_band(spark, sf_dir):
    return rows(spark, sf_dir).select(*ID, rules.base_risk_band(scoring.stand_in_probability(), F.lit(THRESHOLD)).alias("band"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 >= 2 AND o_orderkey % 3 >= 1 THEN CASE b WHEN 'Low' THEN 'Medium' ELSE 'High' END ELSE b END AS band
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Low' WHEN 'O' THEN 'Medium' ELSE 'High' END AS b FROM orders)""")
def escalate_band(spark, sf_dir):
    band = F.when(F.col("o_orderstatus") == "F", "Low").when(F.col("o_orderstatus") == "O", "Medium").otherwise("High")
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", rules.escalate_band(band, F.col("o_orderkey") % 4, F.col("o_orderkey") % 3).alias("band"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN a <> '' THEN a END, CASE WHEN b <> '' AND b <> a THEN b END, CASE WHEN c <> '' AND c <> a AND c <> b THEN c END], lambda x: x IS NOT NULL)[1:2], '|') AS reasons
FROM (SELECT o_orderkey, trim(o_orderstatus || ' ') AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS b, trim(o_orderpriority) AS c FROM orders)""")
def top_reasons(spark, sf_dir):
    found = F.array(F.concat("o_orderstatus", F.lit(" ")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(" "), F.col("o_orderpriority"))
    return panel.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(rules.top_reasons(found, 2), "|").alias("reasons"))


@query(f"WITH {DECIDED_SQL} SELECT {IDS}, array_to_string(peers, '|') AS model_reasons FROM decided")
def heuristic_reasons(spark, sf_dir):
    df = stored_features(spark, sf_dir)
    return scoring.heuristic_reasons(df, scoring.sector_reference(df)).select(*ID, F.array_join("model_reasons", "|").alias("model_reasons"))


@query(f"""WITH {FEATURES_SQL} SELECT {IDS}, array_to_string(list_transform(list_sort(list_filter([
  {{'share': coalesce(debt_to_assets, 0) * 0.8::DOUBLE, 'feature': 'debt_to_assets'}}, {{'share': coalesce(cfo_margin, 0) * -3.0::DOUBLE, 'feature': 'cfo_margin'}}, {{'share': coalesce(roa, 0) * -2.0::DOUBLE, 'feature': 'roa'}}
], lambda x: x.share > 0), 'DESC')[1:2], lambda x: 'The model weighs ' || x.feature || ' as a risk.'), '|') AS model_reasons FROM row_features""")
def linear_contributions(spark, sf_dir):
    df = scoring.linear_contributions(rows(spark, sf_dir), {"debt_to_assets": 0.8, "cfo_margin": -3.0, "roa": -2.0}, limit=2)
    return df.select(*ID, F.array_join("model_reasons", "|").alias("model_reasons"))


@query(f"WITH {TEMPORAL_SQL} SELECT {IDS}, ({MISSING_SQL}) / {float(len(scoring.MODEL_INPUTS))}::DOUBLE AS imputed_fraction FROM features")
def imputed_fraction(spark, sf_dir):
    return full(spark, sf_dir).select(*ID, scoring.imputed_fraction().alias("imputed_fraction"))


@query(f"WITH {FEATURES_SQL}, m AS (UNPIVOT (SELECT sector, " + ", ".join(f"median({f}) AS {f}" for f in scoring.PEER_FEATURES) + " FROM row_features GROUP BY 1) ON " + ", ".join(scoring.PEER_FEATURES) + " INTO NAME feature VALUE median) SELECT sector, feature, median FROM m")
def sector_reference(spark, sf_dir):
    return scoring.sector_reference(rows(spark, sf_dir))


@query(f"""WITH {FEATURES_SQL}, m AS (SELECT sector AS s, median(current_ratio) AS med FROM row_features GROUP BY 1)
SELECT {IDS}, current_ratio, med AS sector_median, current_ratio < med AS worse FROM row_features LEFT JOIN m ON sector = s""")
def sector_relative(spark, sf_dir):
    df = rows(spark, sf_dir)
    medians = scoring.sector_reference(df, ("current_ratio",)).select(F.col("sector").alias("s"), F.col("median").alias("sector_median"))
    return df.join(medians, F.col("sector") == F.col("s"), "left").select(*ID, "current_ratio", "sector_median", (F.col("current_ratio") < F.col("sector_median")).alias("worse"))


@query(f"WITH {panel.SQL} SELECT {IDS}, revenue FROM company_year QUALIFY row_number() OVER (PARTITION BY cin ORDER BY financial_year DESC, company_name) = 1")
def latest_row_per_company(spark, sf_dir):
    return scoring.latest_row_per_company(panel.company_years(spark, sf_dir)).select(*ID, "revenue")


@query(f"WITH {DECIDED_SQL} SELECT cin, string_agg(financial_year || ':' || risk_band || ':' || n_flags, ',' ORDER BY financial_year) AS years FROM decided GROUP BY 1")
def yearwise_scores(spark, sf_dir):
    scores = scoring.roll_up(decided(spark, sf_dir))
    one = lambda x: F.concat_ws(":", x["financial_year"], x["risk_band"], x["rule_flag_count"])
    return scores.select("cin", F.array_join(F.transform("yearwise_scores", one), ",").alias("years"))


WARN_SQL = f"""{DECIDED_SQL},
last AS (SELECT cin, arg_max(risk_band, financial_year) AS band, arg_max(n_flags, financial_year) AS flags, arg_min(sector, financial_year) AS sector, count(*) AS n, max(imputed) AS imputed,
  bool_or({' OR '.join(f'{c} IS NULL' for c in scoring.KEY_FIELDS)}) AS missing FROM decided GROUP BY 1)"""


@query(f"""WITH {WARN_SQL} SELECT cin, array_to_string(list_filter([
  CASE WHEN n = 1 THEN 'One year only, so there are no trends.' END, CASE WHEN imputed > 0.3 THEN 'Over 30% of the model''s inputs were missing in some year.' END,
  CASE WHEN sector NOT IN ('BUILDING', 'MACHINERY') THEN 'The sector was not in the training data.' END,
  CASE WHEN band = 'Medium' AND flags = 0 THEN 'Medium without any red flag; look at it by hand.' END, CASE WHEN missing THEN 'A key figure was missing.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM last""")
def score_warnings(spark, sf_dir):
    return scoring.roll_up(decided(spark, sf_dir), ["BUILDING", "MACHINERY"]).select("cin", F.array_join("warnings", "|").alias("warnings"))


@query(f"""WITH {DECIDED_SQL} SELECT cin, max(financial_year) AS latest_financial_year, count(*)::INT AS years_received, round(arg_max(p, financial_year), 9) AS ml_probability,
  arg_max(risk_band, financial_year) AS risk_band, arg_max(n_flags, financial_year) AS rule_flag_count FROM decided GROUP BY 1""")
def score_companies(spark, sf_dir):
    df = scoring.score_companies(panel.company_years(spark, sf_dir), THRESHOLD)
    return df.select("cin", "latest_financial_year", "years_received", F.round("ml_probability", 9).alias("ml_probability"), "risk_band", "rule_flag_count")


@query(f"""WITH {DECIDED_SQL} SELECT cin, arg_max(array_to_string(names, '|'), financial_year) AS rule_flags_triggered, arg_max(array_to_string(top, ' | '), financial_year) AS top_reasons FROM decided GROUP BY 1""")
def flatten_scores(spark, sf_dir):
    return scoring.flatten_scores(scoring.roll_up(decided(spark, sf_dir))).select("cin", "rule_flags_triggered", "top_reasons")


SUMMARY_SQL = f"""'Probability ' || format('{{:.3f}}', round_even(p, 3)) || ', threshold {THRESHOLD:.3f}. ' || CASE WHEN n_flags > 0 THEN n_flags || ' red flag(s) by rule.' ELSE 'No red flags by rule.' END
  || CASE WHEN len(top) > 0 THEN ' Reasons: ' || array_to_string(top, '; ') ELSE '' END"""
FRAMING_SQL = "'" + rules.FRAMING.replace("'", "''") + "'"


@query(f"WITH {DECIDED_SQL} SELECT {IDS}, {SUMMARY_SQL} AS support_summary, {FRAMING_SQL} AS framing_message FROM decided")
def support_summary(spark, sf_dir):
    return decided(spark, sf_dir).select(*ID, "support_summary", "framing_message")
