"""Rows that models are fitted on are made once."""

from ledgerline.operators import training
from ledgerline.plans import queries_models as qm
from ledgerline.plans.registry import QUERIES


def test_all_models_of_a_leaderboard_share_stored_rows_and_medians(spark, monkeypatch):
    calls, seen = [], []
    rows, filled = qm.rows, training.imputer
    monkeypatch.setattr(qm, "rows", lambda *a: calls.append("rows") or rows(*a))
    monkeypatch.setattr(training, "imputer", lambda *a: calls.append("imputer") or filled(*a))

    def fit(train, val, name, grid, columns, test=None, reference=None, filled=None):
        seen.append((name, filled, [df._jdf.queryExecution().toString() for df in (train, val, test)]))
        row = {c.split()[0]: None for c in training.LEADERBOARD.split(", ")}
        return None, row | {"model": name, "val_pr_auc": 0.5, "val_brier": 0.1}

    monkeypatch.setattr(training, "fit_grid", fit)
    board = QUERIES["leaderboard"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["model"] for r in board if r["production"]) == ["logistic_regression"] and len(board) == 3
    assert calls == ["rows", "imputer"]
    assert all(imputer is not None and not any("Join" in plan or "Aggregate" in plan for plan in plans) for _, imputer, plans in seen)


def test_a_shared_imputer_gives_the_same_model(spark):
    data = [(i % 3 // 2, "ab"[i % 2], None if i % 7 == 0 else float(i % 11) + i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "target_wilful_default int, sector string, x double")
    own, row = training.fit_grid(df, df, "logistic_regression", [{"C": 1.0}], ["x"], test=df)
    shared, again = training.fit_grid(df, df, "logistic_regression", [{"C": 1.0}], ["x"], test=df, filled=training.imputer(df, ["x"]))
    assert row == again and list(own.model.stages[-1].coefficients) == list(shared.model.stages[-1].coefficients)
