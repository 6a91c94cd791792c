"""Red-flag rules compiled to column expressions, and the hybrid decision over a model's probability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, severity, condition, reason), critical rules first. A condition is (feature, operator, threshold), or
#: ("all" or "any", conditions). Names, features and thresholds are fixed values.
RULES = [
    ("weak_interest_coverage", "critical", ("interest_coverage", "lt", 1.0), "Operating earnings do not cover interest."),
    ("excessive_leverage", "critical", ("debt_to_equity", "gt", 2.0), "Debt is more than twice the equity."),
    ("weak_liquidity", "critical", ("current_ratio", "lt", 1.0), "Short-term assets do not cover short-term dues."),
    ("negative_operating_cash_flow", "critical", ("all", [("cfo", "lt", 0), ("revenue", "gt", 0)]), "Operations use up cash although there is revenue."),
    ("negative_profit_margin", "critical", ("net_profit_margin", "lt", 0), "The year ended with a loss."),
    ("qualified_audit_signal", "critical", ("auditor_qualification_flag", "eq", 1), "The audit opinion was not clean."),
    ("going_concern_warning", "critical", ("going_concern_uncertainty_flag", "eq", 1), "The auditors doubt that the company can go on."),
    ("large_contingent_liabilities", "critical", ("contingent_to_networth_ratio", "gt", 0.5), "Possible liabilities are over half of net worth."),
    ("declining_revenue_trend", "trend", ("revenue_trend_3y", "lt", 0), "Revenue falls over the years."),
    ("declining_cash_flow_trend", "trend", ("cfo_trend_3y", "lt", 0), "Operating cash flow falls over the years."),
    ("rising_borrowings_trend", "trend", ("total_borrowings_trend_3y", "gt", 0), "Borrowings rise over the years."),
    ("leverage_spike", "trend", ("debt_to_equity_yoy", "gt", 0.25), "Leverage jumped within a year."),
    ("margin_drop", "trend", ("net_profit_margin_yoy", "lt", -0.05), "The profit margin dropped within a year."),
]
MEDIUM_MARGIN = 0.15
FRAMING = "The score says how closely the figures resemble earlier distress cases; it is no finding about the company."


def condition(rule) -> Column:
    """A rule's condition; missing values make a comparison false, an unknown operator is an error."""
    if rule[0] in ("all", "any"):
        parts = [condition(x) for x in rule[1]]
        return reduce(lambda a, b: a & b if rule[0] == "all" else a | b, parts) if parts else F.lit(rule[0] == "all")
    feature, operator, threshold = rule
    tests = {"lt": lambda c, t: c < t, "gt": lambda c, t: c > t, "eq": lambda c, t: c == t}
    if operator not in tests:
        raise ValueError(f"no rule operator is named {operator}")
    return F.coalesce(tests[operator](F.col(feature), F.lit(threshold)), F.lit(False))


def rule_flags(rules=RULES) -> Column:
    """The triggered rules in order, as structs of name, severity and reason."""
    found = [F.when(condition(c), F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))) for name, severity, c, reason in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def base_risk_band(p: Column, t: Column) -> Column:
    return F.when(p >= t, "High").when(p >= t - MEDIUM_MARGIN, "Medium").otherwise("Low")


def escalate_band(band: Column, triggered: Column, critical: Column) -> Column:
    """One step up with two flags or more of which one is critical."""
    up = F.when(band == "Low", "Medium").otherwise("High")
    return F.when((triggered >= 2) & (critical >= 1), up).otherwise(band)


def top_reasons(reasons: Column, limit: int = 3) -> Column:
    """The first distinct reasons that aren't blank."""
    trimmed = F.transform(reasons, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x != "")), 1, limit)


def three_places(x: Column) -> Column:
    return F.format_string("%.3f", F.bround(x, 3))


def support_summary(p: Column, t: Column, count: Column, reasons: Column) -> Column:
    flags = F.when(count > 0, F.concat(count.cast("string"), F.lit(" red flag(s) by rule."))).otherwise("No red flags by rule.")
    why = F.when(F.size(reasons) > 0, F.concat(F.lit("Reasons: "), F.array_join(reasons, "; ")))
    return F.concat_ws(" ", F.concat(F.lit("Probability "), three_places(p), F.lit(", threshold "), three_places(t), F.lit(".")), flags, why)


def hybrid_decision(df: DataFrame, probability: str, threshold: float, model_reasons: str | None = None, rules=RULES) -> DataFrame:
    """df with the flags, band, reasons and summary of each row; no shuffle."""
    p, t = F.col(probability), F.lit(float(threshold))
    df = df.withColumn("triggered", rule_flags(rules))
    count = F.size("triggered")
    critical = F.size(F.filter("triggered", lambda x: x["severity"] == "critical"))
    reasons = F.transform("triggered", lambda x: x["reason"])
    if model_reasons:
        reasons = F.concat(reasons, F.coalesce(F.col(model_reasons), F.array().cast("array<string>")))
    df = df.withColumns({
        "ml_probability": p,
        "model_threshold": t,
        "ml_class": (p >= t).cast("int"),
        "rule_flags_triggered": F.transform("triggered", lambda x: x["name"]),
        "rule_flag_count": count,
        "critical_rule_count": critical,
        "risk_band": escalate_band(base_risk_band(p, t), count, critical),
        "top_reasons": top_reasons(reasons),
        "framing_message": F.lit(FRAMING),
    })
    return df.withColumn("support_summary", support_summary(p, t, F.col("rule_flag_count"), F.col("top_reasons"))).drop("triggered")
