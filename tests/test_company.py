"""Goldens of features, rules and metrics, with edge cases."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as sc
from ledgerline.operators import cohorts, evaluate, extract, features, matching, quality, rules, scoring, selection
from ledgerline.plans import download_plan
from ledgerline.plans.panel import COLUMNS, NUMERIC
from ledgerline.sources.tables import append_with_checkpoint, read_company_list, read_json_rows, typed_company_years, write_table

CIN = "L27100MH1995PLC084207"
#: Three years of a company in distress, made so that every ratio can be worked out by hand.
YEARS = [
    {"financial_year": 2021, "revenue": 750.0, "pat": -50.0, "interest_expense": 70.0, "tax_expense": 10.0, "total_equity": 210.0, "total_borrowings": 550.0, "total_assets": 1000.0, "cfo": -25.0, "current_assets": 215.0, "current_liabilities": 310.0},
    {"financial_year": 2022, "revenue": 550.0, "pat": -80.0, "interest_expense": 80.0, "tax_expense": 0.0, "total_equity": 0.0, "total_borrowings": 725.0, "total_assets": 1000.0, "cfo": None, "current_assets": 260.0, "current_liabilities": 0.0},
    {"financial_year": 2023, "revenue": 375.0, "pat": -105.0, "interest_expense": 0.0, "tax_expense": 0.0, "total_equity": -5.0, "total_borrowings": 1260.0, "total_assets": 1000.0, "cfo": -195.0, "current_assets": None, "current_liabilities": 380.0},
]


def frame(spark, years, **more):
    kinds = ", ".join(f"{c} {'int' if c == 'financial_year' else 'double' if c in NUMERIC else 'string'}" for c in COLUMNS)
    base = {"company_name": "Example Ltd", "cin": CIN, "sector": "Steel", "cohort": " defaulter "} | more
    return spark.createDataFrame([tuple((base | y).get(c) for c in COLUMNS) for y in years], kinds)


def test_features_by_hand(spark):
    rows = features.build_features(frame(spark, YEARS)).orderBy("financial_year").collect()
    assert len(rows[0].__fields__) == 121
    a, b, c = rows
    assert (a.ebit, a.interest_coverage, round(a.debt_to_equity, 4), round(a.current_ratio, 4)) == (30.0, 30 / 70, 2.619, 0.6935)
    assert b.debt_to_equity is None and b.current_ratio is None and b.roe is None and c.interest_coverage is None
    assert a.revenue_trend_3y == pytest.approx(-187.5) and b.revenue_trend_3y == a.revenue_trend_3y and a.cfo_trend_3y == pytest.approx(-85.0)
    assert (b.revenue_yoy, a.revenue_yoy, c.cfo_yoy) == (-200 / 750, None, None)
    assert (a.target_wilful_default, a.incorporation_year, a.company_age, a.auditor_changed_yoy) == (1, 1995, 26, 0.0)
    assert [r.relative_year_from_latest for r in rows] == [-2, -1, 0]
    one = features.build_features(frame(spark, YEARS[:1])).first()
    assert one.revenue_trend_3y is None and one.revenue_volatility_3y is None


def test_rules_and_bands(spark):
    rows = features.build_features(frame(spark, YEARS)).withColumn("p", F.lit(0.4))
    rows = rules.hybrid_decision(rows, "p", 0.5).orderBy("financial_year").collect()
    assert rows[0].rule_flags_triggered == ["weak_interest_coverage", "excessive_leverage", "weak_liquidity", "negative_operating_cash_flow", "negative_profit_margin", "declining_revenue_trend", "declining_cash_flow_trend", "rising_borrowings_trend"]
    assert rows[0].risk_band == "High" and rows[0].ml_class == 0 and len(rows[0].top_reasons) == 3
    with pytest.raises(ValueError):
        rules.condition(("cfo", "near", 1))


def test_scoring_warns(spark):
    got = scoring.score_companies(frame(spark, YEARS[:1]), known_sectors=["Cement"]).first()
    assert got.years_received == 1 and len(got.yearwise_scores) == 1 and len(got.warnings) >= 2
    flat = scoring.flatten_scores(scoring.score_companies(frame(spark, YEARS))).first()
    assert flat.latest_financial_year == 2023 and flat.yearwise_scores.startswith("[{")


def test_scalars(spark):
    rows = [("L27100MH1995PLC084207", "Rs. 1,200.50", "(1,234)", "2016.0"), (" l27100mh1995 plc084207", "('1,200.50')", "--", "nan"), ("-", "inf", "1d", "1890"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = df.select(sc.normalize_cin(F.col("a")), sc.clean_amount(F.col("b")), sc.parse_amount(F.col("c")), sc.parse_year(F.col("d")), sc.cin_incorporation_year(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(CIN, None, -1234.0, 2016, 1995), (CIN, 1200.5, None, None, None), (None, None, None, None, None), (None,) * 5]


def test_published_confusion_and_choice(spark):
    cells = {"lr": (23, 1, 5, 16, 0.9412, 0.7619, 0.8421, 0.8667), "rf": (20, 4, 0, 21, 0.84, 1.0, 0.913, 0.9111)}
    for tn, fp, fn, tp, precision, recall, f1, accuracy in cells.values():
        rows = [(0, 0.1)] * tn + [(0, 0.9)] * fp + [(1, 0.1)] * fn + [(1, 0.9)] * tp
        m = evaluate.confusion_metrics(spark.createDataFrame(rows, "y int, p double"), 0.5).first()
        assert (round(m.precision, 4), round(m.recall, 4), round(m.f1, 4), round(m.accuracy, 4)) == (precision, recall, f1, accuracy)
    board = spark.createDataFrame([("logistic_regression", 0.9278, 0.1523), ("random_forest", 0.8808, 0.1538), ("hist_gradient_boosting", 0.8964, 0.1510)], "model string, val_pr_auc double, val_brier double")
    assert evaluate.choose_production(board).first().model == "logistic_regression"


def test_areas_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (0, 1.0)], "y int, p double")
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(2.5 / 6)
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.5 * (1 / 3) + 0.5 * 0.5)
    assert evaluate.threshold_table(df).count() == 81


def test_plan_rounds_half_to_even_and_falls_back(spark):
    d = spark.createDataFrame([("a", CIN, "S", None, "2016"), ("b", CIN, "S", None, "2017"), ("c", CIN, "T", "2018", None), ("d", CIN, "U", None, None)], "company_name string, cin string, sector string, default_year string, fy_before_default string")
    anchored = download_plan.defaulter_anchor(d)
    assert [(r.anchor_fy, r.anchor_reason) for r in anchored.orderBy("company_name").collect()] == [(2016, "fy_before_default"), (2017, "fy_before_default"), (2017, "default_year-1"), (2023, "fallback_default_anchor_fy")]
    assert {r.sector: r.median_anchor for r in download_plan.median_anchor(anchored, "sector").collect()} == {"S": 2016, "T": 2017, "U": 2023}
    controls = spark.createDataFrame([("x", CIN, "S"), ("y", "U" + CIN[1:], None)], "company_name string, cin string, sector string")
    plan = download_plan.download_plan(d, controls)
    assert plan.count() == 6 * 3 * 9 and plan.filter("not is_listed").select("source_priority").distinct().first()[0] == "mca"


def test_selection_ignores_null_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, None if i % 2 else float(i), 5.0) for i in range(20)], "a double, b double, c double, d double")
    pairs = selection.correlation_matrix(df, ["a", "b", "c", "d"])
    assert {r.feature for r in selection.correlation_filter(pairs).collect()} == {"b", "c"}
    assert {r.feature for r in quality.constant_columns(df, ["a", "c", "d"]).collect()} == {"d"}
    split = selection.company_split(spark.range(4000).select(F.col("id").cast("string").alias("cin")))
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert abs(n["train"] - 2800) < 120 and abs(n["val"] - 600) < 80


def test_texts_and_matching(spark):
    text = "Unqualified opinion with going concern and material uncertainty; fraud reported"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    loose = df.select(extract.auditor_flags(F.col("t")).alias("x")).collect()
    assert loose[0].x.opinion_type == "qualified" and loose[1].x.opinion_type == "unqualified" and loose[0].x.going_concern_uncertainty == 1
    assert df.select(extract.auditor_flags(F.col("t"), mode="strict").alias("x")).first().x.opinion_type == "unqualified"
    left = spark.createDataFrame([("Alpha Steel Limited", "1"), ("Unknown Co", "2")], "company_name string, cin string")
    right = spark.createDataFrame([("A1", "Steel Alpha Limited", 0), ("A2", "Alpha Steel Limited", 1), ("B", "Beta Foods", 2)], "code string, name string, place long")
    got = {r.cin: (r.code, r.score) for r in matching.fuzzy_match_names(left, right).collect()}
    assert got["1"] == ("A1", 100.0) and got["2"][0] is None


def test_sources_and_checkpoints(spark, tmp_path):
    (tmp_path / "list.csv").write_text("Company  Name,CIN No\nOne,L27100MH1995PLC084207\n ,x\nTwo,NA\n")
    rows = read_company_list(spark, str(tmp_path / "list.csv")).orderBy("source_row").collect()
    assert [tuple(r) for r in rows] == [("One", CIN, 0), ("Two", None, 2)]
    (tmp_path / "j").mkdir()
    for i, body in enumerate(('{"rows": [{"a": 1}, {"a": 2}]}', '[{"a": 3}]', '{"a": 4}')):
        (tmp_path / "j" / f"{i}.json").write_text(body)
    from pyspark.sql.types import StructType

    assert sorted(r.a for r in read_json_rows(spark, str(tmp_path / "j"), StructType().add("a", "long")).collect()) == [1, 2, 3, 4]
    typed = typed_company_years(spark.createDataFrame([("One", "2020", "1e3"), ("Two", "N/A", "12 lakh")], "company_name string, financial_year string, revenue string")).orderBy("company_name").collect()
    assert [(r.financial_year, r.revenue) for r in typed] == [(2020, 1000.0), (None, None)]
    df = spark.createDataFrame([("a", 2020), ("a", 2021), ("a", 2021), ("b", 2020)], "cin string, financial_year int")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    append_with_checkpoint(df, df.filter("cin = 'b'"), out, mark)
    assert spark.read.parquet(out).count() == 2 and spark.read.parquet(mark).count() == 2
    append_with_checkpoint(df, spark.read.parquet(mark).unionByName(df.filter("cin = 'b'")), out, mark)
    assert spark.read.parquet(out).count() == 2
    write_table(df.limit(0), str(tmp_path / "none"), partition=None)
    assert spark.read.parquet(str(tmp_path / "none")).columns == ["cin", "financial_year"]
    assert cohorts.rows_missing_cin(df.withColumn("cin", F.lit(None).cast("string"))).count() == 4


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "risk_flags_latest" in __spark_entry__.queries()


def test_figures_and_names_in_prose(spark):
    from ledgerline.operators import extract

    cases = {
        "promoter_pct": [("Promoters and Group: 45.20 %", 45.2), ("PROMOTER 51", 51.0), ("62.5 % of the shares by promoter", 62.5), ("7% promoter", 7.0), ("no such thing 5", None), (None, None)],
        "rpt_amount": [("related  party dealings, amount: 1,200.50 in all", 1200.5), ("RPT of Rs. 30", 30.0), ("12,000 crore with a related party", 12000.0), ("4 cr. related party", 4.0), ("related party only", None)],
        "contingent_amount": [("Contingent liabilities not provided for Rs. 9,100", 9100.0), ("contingent liability INR: 5.", 5.0), ("7.25 cr. of contingent claims", 7.25), ("contingent 8", None)],
    }
    for name, rows in cases.items():
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string")
        got = {r.i: r.x for r in df.select("i", getattr(extract, name)(F.col("t")).alias("x")).collect()}
        assert got == {i: x for i, (_, x) in enumerate(rows)}, name
    rows = [("Statutory Auditor: A. Smith & Co for the year", "A. Smith & Co"), ("auditor report: Jones and Sons\nnext", "Jones and Sons"), ("by M/s Rao-Iyer, Chartered Accountants", "Rao-Iyer"), ("nobody here", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string")
    assert {r.i: r.x for r in df.select("i", extract.auditor_name(F.col("t")).alias("x")).collect()} == {i: x for i, (_, x) in enumerate(rows)}


def test_correlation_of_large_values_with_a_small_spread(spark):
    from ledgerline.operators import selection

    rows = [(1e9 + i % 7, 5e8 - i % 7, 0.1, float(i * i % 11)) for i in range(500)]
    got = {(r.a, r.b): r.r for r in selection.correlation_matrix(spark.createDataFrame(rows, "p double, q double, same double, s double"), ["p", "q", "same", "s"]).collect()}
    assert abs(got["p", "q"] - 1) < 1e-9 and got["p", "same"] is None and got["p", "s"] < 0.5


def test_company_list_of_another_encoding(spark, tmp_path):
    from ledgerline.sources import tables

    path = tmp_path / "list.csv"
    path.write_bytes("Borrower Name,Company Registration Number\nSociété Été,L27100MH1995PLC084207\n,\nZwei,-\n".encode("latin-1"))
    got = [(r.company_name, r.cin, r.source_row) for r in tables.read_company_list(spark, str(path)).orderBy("source_row").collect()]
    assert got == [("Société Été", "L27100MH1995PLC084207", 0), ("Zwei", None, 2)]
