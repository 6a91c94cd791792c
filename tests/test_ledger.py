"""Ledgers, appends that start again, ordered files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources import tables
from ledgerline.sources.ledger import Ledger
from ledgerline.streaming import incremental

SCHEMA = T.StructType().add("cin", "string").add("x", "integer")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def contents(df):
    return sorted((r["cin"], r["x"]) for r in df.collect())


def test_batches_are_there_as_a_whole_or_not_at_all(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l", "cin", SCHEMA, buckets=8)
    assert ledger.read().count() == 0
    assert ledger.append(frame(spark, [("a", 1), ("b", 2)]), 0)
    ledger._write(frame(spark, [("c", 3)]), "1")  # a job that died before its commit
    assert contents(ledger.read()) == [("a", 1), ("b", 2)]
    assert ledger.append(frame(spark, [("d", 4)]), 1) and not ledger.append(frame(spark, [("e", 5)]), 1)
    assert contents(ledger.read()) == [("a", 1), ("b", 2), ("d", 4)] and contents(ledger.read(before=1)) == [("a", 1), ("b", 2)]
    ledger.compact()
    assert ledger.batches() == ["c1"] and ledger.committed(0) and contents(ledger.read()) == [("a", 1), ("b", 2), ("d", 4)]
    ledger.append(frame(spark, [("f", 6)]), 2)
    assert ledger.batches() == ["c1", "2"] and ledger.read().count() == 4


def test_only_the_buckets_of_the_batch_are_read(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l", "cin", SCHEMA, buckets=16)
    ledger.append(frame(spark, [(f"c{i}", i) for i in range(500)]), 0)
    rows = ledger.read(ledger.touched(frame(spark, [("c7", 0)])))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1 and ("c7", 7) in contents(rows)


def test_append_starts_again_after_a_crash(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", 2020, 5), ("a", 2020, 4), ("b", 2020, 1), ("c", 2021, 9)], "cin string, financial_year int, v int")
    none, out, mark = df.limit(0), str(tmp_path / "out"), str(tmp_path / "mark")
    calls = []

    def dies(*args):
        calls.append(args)
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as m:
        real = tables.without
        m.setattr(tables, "without", lambda *a: real(*a) if not calls and not calls.append(0) else dies(*a))
        with pytest.raises(RuntimeError):
            tables.append_with_checkpoint(df, none, out, mark)
    assert spark.read.parquet(out).count() == 3
    tables.append_with_checkpoint(df, none, out, mark)
    tables.append_with_checkpoint(df.repartition(3), none, out, mark)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 2020, 4), ("b", 2020, 1), ("c", 2021, 9)]
    assert spark.read.parquet(mark).count() == 3


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path, monkeypatch):
    from ledgerline.plans import panel

    years = panel.company_years(spark, "/root/testdata/sf0.001").filter("cin like '%1'")
    facts, scores = f"file://{tmp_path}/facts", f"file://{tmp_path}/scores"
    incremental.take_batch(years.filter("financial_year <= 1995"), 0, facts, scores)
    later = years.filter("financial_year > 1994")
    with monkeypatch.context() as m:  # dies between facts and scores
        m.setattr(incremental, "score_companies", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            incremental.take_batch(later, 1, facts, scores)
    incremental.take_batch(later, 1, facts, scores)
    incremental.take_batch(later, 1, facts, scores)
    whole = incremental.score_companies(years).select("cin", "years_received", "risk_band")
    got = incremental.latest_scores(spark, scores, incremental.score_companies(years).schema)
    assert sorted(map(tuple, got.select("cin", "years_received", "risk_band").collect())) == sorted(map(tuple, whole.collect()))
    assert Ledger(spark, facts, "cin", years.schema).read().count() == years.count()


def test_ordered_files_do_not_overlap_and_a_hot_key_fills_several(spark, tmp_path):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"), "id")
    tables.write_table(df, str(tmp_path / "o"), order=["k"], rows_per_file=300)
    rows = spark.read.parquet(str(tmp_path / "o")).select("k", F.input_file_name().alias("f"))
    files = sorted((r["a"], r["b"]) for r in rows.groupBy("f").agg(F.min("k").alias("a"), F.max("k").alias("b")).collect())
    assert rows.count() == 4000 and all(x[1] <= y[0] for x, y in zip(files, files[1:]))
    assert sum(a <= 7 <= b for a, b in files) >= 3
