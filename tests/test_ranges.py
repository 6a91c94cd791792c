"""Medians, ranks and splits of groups that lie in many ranges, and company lists of many files."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evaluate, extract, ranges, selection
from ledgerline.sources import tables


def test_medians_by_narrowing(spark):
    """Groups of every kind: ties at the middle, two far halves, even and odd numbers, heavy tails, one value, none."""
    rng = random.Random(4)
    groups = {
        "ties": [1.0] * 400 + [2.0] * 350 + [3.0] * 251, "halves": [-1e300] * 300 + [1e300] * 300, "tails": [rng.paretovariate(0.3) for _ in range(1500)],
        "even": [float(i * i) for i in range(1000)], "one": [7.5], "two": [1.0, 4.0], "near": [1 + i * 2e-16 for i in range(901)], None: [float(i) for i in range(777)],
    }
    rows = [(g, x, -x if i % 2 else None) for g, xs in groups.items() for i, x in enumerate(xs)] + [("none", None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {(r["g"], r["feature"]): r["median"] for r in ranges.exact_medians(df, ["x", "y"], ["g"], few=20).collect()}
    want = {}
    for g in groups:
        for c, at in (("x", 1), ("y", 2)):
            if xs := sorted(r[at] for r in rows if r[0] == g and r[at] is not None):
                want[g, c] = 0.5 * xs[(len(xs) - 1) // 2] + 0.5 * xs[len(xs) // 2] if len(xs) % 2 == 0 else statistics.median(xs)
    assert got == want


def test_medians_of_many_different_values_in_one_group(spark):
    df = spark.range(3_000_001).select(F.lit("s").alias("g"), (F.pmod(F.col("id") * 1_000_003, F.lit(3_000_001)) / 2).alias("x"))
    assert [r["median"] for r in ranges.exact_medians(df, ["x"], ["g"]).collect()] == [750_000.0]


def test_ranks_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "a", float(rng.randrange(300)) if i % 11 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "sector string, score double, i long")
    got = {r["i"]: (r["rank"], r["percent_rank"], r["group_rows"]) for r in ranges.rank_within(df, "sector", "score", rows_per_range=40).collect()}
    assert len(got) == len(rows)
    for s, x, i in rows:
        mine = [r[1] for r in rows if r[0] == s and r[1] is not None]
        ahead = sum(v > x for v in mine) if x is not None else None
        assert got[i] == ((None, None, None) if x is None else (ahead + 1, ahead / (len(mine) - 1), len(mine)))


def test_scores_crowded_near_zero_fall_in_many_ranges(spark):
    rows = [(i % 5 == 0, i * i * 1e-12) for i in range(1500)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "y int, p double")
    got = evaluate.score_counts(df, rows_per_range=50).collect()
    for r in got:
        assert r["pos_above"] == sum(y for y, p in rows if p > r["p"]) and r["neg_above"] == sum(not y for y, p in rows if p > r["p"])


def test_stratified_split_has_exact_counts(spark):
    rows = [(f"c{i}", y, "bad" if i % 10 == 0 else "good") for i in range(999) for y in (1, 2)]
    df = spark.createDataFrame(rows, "cin string, financial_year int, cohort string")
    got = selection.stratified_split(df, "cohort", rows_per_range=30)
    assert got.groupBy("cin").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    counts = {(r["split"], r["cohort"]): r["n_companies"] for r in selection.split_counts(got, "cohort").collect()}
    assert counts == {("train", "bad"): 70, ("val", "bad"): 15, ("test", "bad"): 15, ("train", "good"): 629, ("val", "good"): 135, ("test", "good"): 135}
    with pytest.raises(ValueError, match="fewer than two classes"):
        selection.stratified_split(df.filter("cohort = 'good'"), "cohort")


def test_temporal_split_keeps_companies_whole(spark):
    rows = [(f"c{i}", y, (1990 + i % 10) if i % 2 else None) for i in range(200) for y in (1988, 1999)]
    got = selection.temporal_split(spark.createDataFrame(rows, "cin string, financial_year int, default_year int"), 1995)
    assert got.groupBy("cin").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    assert {(r["default_year"] <= 1995, r["split"]) for r in got.filter("default_year is not null").collect()} == {(True, "train"), (False, "test")}


def test_line_items_do_not_depend_on_the_order_of_rows(spark):
    rows = [("c", 2020, 0, p, " Net SALES", v) for p in (3, 4) for v in (9.0, 2.0, 5.0)] + [("c", 2020, 0, 1, "sales", None), ("c", 2020, 0, 2, "Other sales income", 8.0)]
    patterns = spark.createDataFrame([("revenue", 2, "sales income"), ("revenue", 1, "net sales")], "field string, rank int, pattern string")
    for n in (1, 2, 5):
        random.Random(n).shuffle(rows)
        items = spark.createDataFrame(rows, "cin string, financial_year int, table_pos int, row_pos int, label string, value double").repartition(n)
        assert extract.match_line_items(items, patterns).first()["value"] == 2.0
        assert extract.match_line_items(items, patterns, "report", 10.0).first()["value"] == 80.0


def test_every_file_has_its_own_header_and_encoding(spark, tmp_path):
    cin = "L27100MH1995PLC084207"
    (tmp_path / "a.csv").write_bytes(f"Company Name,CIN\nOne,{cin}\n\n,x\nNA,\n".encode())
    (tmp_path / "b.csv").write_bytes(f"Corporate Identification Number,State,Borrower\n{cin},MH,Société\n,MH\n{cin},,\"Two, \"\"Ltd\"\"\nSouth\"\n".encode("latin-1"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.csv").write_bytes("﻿NAME\nÜber\n".encode())
    (tmp_path / "deep" / "d.csv").write_bytes("company\ncin\nx\n".encode("utf-16"))
    (tmp_path / "e.csv").write_bytes(b"")
    got = {(r["company_name"], r["cin"], r["source_row"], r["file_row"]) for r in tables.read_company_list(spark, str(tmp_path), places=True).collect()}
    assert got == {("One", cin, 0, 0), ("Société", cin, 3, 0), ('Two, "Ltd"\nSouth', cin, 5, 2), ("Über", None, 6, 0), ("cin", None, 7, 0), ("x", None, 8, 1)}
    (tmp_path / "f.csv").write_text("what,ever\n1,2\n")
    with pytest.raises(Exception, match="f.csv: no company name column among what, ever"):
        tables.read_company_list(spark, str(tmp_path)).collect()
