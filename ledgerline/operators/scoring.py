"""Scoring of companies: probability, reasons, year-wise roll-up, warnings and the flat output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import build_features
from .ranges import exact_medians, stored
from .rules import RULES, hybrid_decision
from .training import Trained

#: Features compared with the sector's median, in order; True where more is worse. Fixed values.
PEER_FEATURES = {
    "debt_to_equity": (True, "More leverage than the sector's median."),
    "current_ratio": (False, "Less liquidity than the sector's median."),
    "interest_coverage": (False, "Interest is covered less than in the sector's median."),
    "net_profit_margin": (False, "Less profit than the sector's median."),
    "cash_flow_to_debt": (False, "Less cash flow for debt than the sector's median."),
    "contingent_to_networth_ratio": (True, "More possible liabilities than the sector's median."),
}
KEY_FIELDS = ("revenue", "pat", "total_equity", "total_borrowings", "total_assets", "cfo")
MODEL_INPUTS = ("current_ratio", "debt_to_equity", "interest_coverage", "net_profit_margin", "cash_flow_to_debt", "contingent_to_networth_ratio", "revenue_yoy", "cfo_yoy")
MOST_IMPUTED = 0.30


def ensure_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with every column of a schema, absent ones null."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def align_model_input(df: DataFrame, columns: list[str]) -> DataFrame:
    """The model's columns in the model's order, absent ones null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def imputed_fraction(columns=MODEL_INPUTS) -> Column:
    """Share of the model's inputs that are null."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(max(len(columns), 1)))


def stand_in_probability() -> Column:
    """A fixed logistic score of two features, for workflows without a trained model."""
    return 1 / (1 + F.exp(-(F.lit(-0.5) + 0.4 * F.least(F.coalesce(F.col("debt_to_equity"), F.lit(1.0)), F.lit(5.0)) - 2.0 * F.coalesce(F.col("net_profit_margin"), F.lit(0.0)))))


def sector_reference(df: DataFrame, features=tuple(PEER_FEATURES)) -> DataFrame:
    """(sector, feature, median) over the values that are there; pairs without any are left out."""
    return exact_medians(df, list(features), ["sector"])


def heuristic_reasons(df: DataFrame, reference: DataFrame, out: str = "model_reasons", limit: int = 3) -> DataFrame:
    """df with the first reasons in which a row is worse than its sector's median."""
    wide = reference.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("__ref")).withColumnRenamed("sector", "__sector")
    df = df.join(wide, F.col("sector") == F.col("__sector"), "left")
    found = []
    for feature, (more_is_worse, label) in PEER_FEATURES.items():
        median = F.try_element_at("__ref", F.lit(feature))
        found.append(F.when(F.col(feature) > median if more_is_worse else F.col(feature) < median, F.lit(label)))
    return df.withColumn(out, F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, limit)).drop("__ref", "__sector")


def linear_contributions(df: DataFrame, coefficients: dict[str, float], out: str = "model_reasons", limit: int = 3) -> DataFrame:
    """df with the features that add most to a linear score, largest first."""
    parts = F.array(*[F.struct((F.coalesce(F.col(f), F.lit(0.0)) * F.lit(w)).alias("share"), F.lit(f).alias("feature")) for f, w in coefficients.items()])
    positive = F.sort_array(F.filter(parts, lambda x: x["share"] > 0), asc=False)
    return df.withColumn(out, F.transform(F.slice(positive, 1, limit), lambda x: F.concat(F.lit("The model weighs "), x["feature"], F.lit(" as a risk."))))


def score_years(features: DataFrame, threshold: float | None = None, reference: DataFrame | None = None, rules=RULES, model: Trained | None = None) -> DataFrame:
    """Every company-year with probability, reasons, decision and imputed share.

    With a trained model its probability, threshold, inputs and sector medians count, and a linear model's own reasons
    where it has any; else the stand-in score at 0.5. What is given by hand goes before the model's.
    """
    if model is None:
        rows = heuristic_reasons(features, reference if reference is not None else sector_reference(features))
        rows = rows.withColumns({"probability": stand_in_probability(), "imputed_feature_fraction": imputed_fraction()})
        return hybrid_decision(rows, "probability", 0.5 if threshold is None else threshold, "model_reasons", rules)
    reference = reference if reference is not None else model.reference
    peers = ensure_schema(features, dict.fromkeys([*PEER_FEATURES, *model.columns], "double"))
    rows = heuristic_reasons(peers, reference if reference is not None else sector_reference(peers), "__peers")
    rows = model.applied(rows.withColumn("imputed_feature_fraction", imputed_fraction(model.columns)))
    own = F.col("model_reasons") if "model_reasons" in rows.columns else F.array().cast("array<string>")
    rows = rows.withColumn("model_reasons", F.when(F.size(own) > 0, own).otherwise(F.col("__peers"))).drop("__peers")
    return hybrid_decision(rows, "probability", model.threshold if threshold is None else threshold, "model_reasons", rules)


YEAR_FIELDS = ("financial_year", "ml_probability", "ml_class", "risk_band", "rule_flag_count", "critical_rule_count", "rule_flags_triggered", "top_reasons", "support_summary", "imputed_feature_fraction")


def roll_up(years: DataFrame, known_sectors: list[str] | None = None) -> DataFrame:
    """One row per cin: the latest year's decision, all years in order, and warnings."""
    year = F.struct(*YEAR_FIELDS)
    missing = F.lit(False)
    for c in KEY_FIELDS:
        missing = missing | F.col(c).isNull()
    rows = years.groupBy("cin").agg(
        F.sort_array(F.collect_list(year)).alias("yearwise_scores"),
        F.max(F.struct("financial_year", "company_name", "ml_probability", "model_threshold", "ml_class", "risk_band", "rule_flags_triggered", "rule_flag_count", "top_reasons", "support_summary", "framing_message")).alias("last"),
        F.min(F.struct("financial_year", F.trim("sector").alias("sector"))).alias("start"),
        F.count(F.lit(1)).cast("int").alias("years_received"),
        F.max("imputed_feature_fraction").alias("imputed"),
        F.max(missing).alias("missing"),
    )
    unseen = F.lit(False) if known_sectors is None else ~F.coalesce(F.col("start.sector").isin(known_sectors), F.lit(False))
    warnings = F.filter(
        F.array(
            F.when(F.col("years_received") == 1, "One year only, so there are no trends."),
            F.when(F.col("imputed") > MOST_IMPUTED, "Over 30% of the model's inputs were missing in some year."),
            F.when(unseen, "The sector was not in the training data."),
            F.when((F.col("last.risk_band") == "Medium") & (F.col("last.rule_flag_count") == 0), "Medium without any red flag; look at it by hand."),
            F.when(F.col("missing"), "A key figure was missing."),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(F.trim("last.company_name").alias("company_name"), "cin", "years_received", F.col("last.financial_year").alias("latest_financial_year"), *[f"last.{c}" for c in ("ml_probability", "model_threshold", "ml_class", "risk_band", "rule_flags_triggered", "rule_flag_count", "top_reasons", "support_summary", "framing_message")], "yearwise_scores", warnings.alias("warnings"))


def score_companies(raw: DataFrame, threshold: float | None = None, reference: DataFrame | None = None, known_sectors: list[str] | None = None, model: Trained | None = None) -> DataFrame:
    """Raw company-years to scored companies, by a trained model or the stand-in; within a cin the history goes by company name.

    With a model its name is a column, and its training sectors are the known ones. Rows whose medians have to be found
    first are read several times, so they are stored.
    """
    if reference is None and (model is None or model.reference is None):
        raw = stored(raw, "company-years")
    years = score_years(build_features(raw, ["cin", "company_name"]), threshold, reference, model=model)
    if model is None:
        return roll_up(years, known_sectors)
    return roll_up(years, list(model.sectors) if known_sectors is None else known_sectors).withColumn("model_name", F.lit(model.name))


def flatten_scores(scores: DataFrame) -> DataFrame:
    """Scored companies with lists joined and the years as JSON."""
    return scores.withColumns({
        "rule_flags_triggered": F.array_join("rule_flags_triggered", "|"),
        "top_reasons": F.array_join("top_reasons", " | "),
        "warnings": F.array_join("warnings", " | "),
        "yearwise_scores": F.to_json("yearwise_scores"),
    })


def latest_row_per_company(df: DataFrame, key: str = "cin", order: str = "financial_year") -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.col(order).desc(), "company_name")
    return df.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
