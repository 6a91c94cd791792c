"""Trained models: imputing, held-out accuracy, saving, scoring; and the recall of name matching against all pairs."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import matching, scoring, training

COLUMNS = ["current_ratio", "debt_to_equity"]
TYPES = "cin string, sector string, current_ratio double, debt_to_equity double, target_wilful_default int"


@pytest.fixture(scope="module")
def parts(spark):
    """Company-years that default where debt is over twice their equity; some inputs and sectors are missing."""
    draw = random.Random(7)
    rows = []
    for i in range(600):
        debt = draw.uniform(0, 4)
        rows.append((f"c{i}", draw.choice(["Steel", "Food", "it's", None, " "]), draw.choice([None, draw.uniform(0, 3)]), debt, int(debt + draw.gauss(0, 0.2) > 2)))
    df = spark.createDataFrame(rows, TYPES)
    n = F.substring("cin", 2, 9).cast("int")
    return df.filter(n < 400), df.filter(n.between(400, 499)), df.filter(n >= 500)


def test_preprocess_imputes_scales_and_encodes(spark, parts):
    rows = [("a", "X", 1.0, None, 0), ("b", "X", 3.0, 2.0, 1), ("c", "Y", None, 4.0, 1), ("d", None, None, None, 0)]
    train = spark.createDataFrame(rows, TYPES)
    model = training.preprocess(train, COLUMNS, scale=False)
    got = {r.cin: list(r.features.toArray()) for r in model.transform(train).collect()}
    assert got == {"a": [1, 3, 1, 0], "b": [3, 2, 1, 0], "c": [2, 4, 0, 1], "d": [2, 3, 1, 0]}
    new = spark.createDataFrame([("e", "Unseen", None, 1.0, 0)], TYPES)
    assert list(model.transform(new).first().features.toArray()) == [2, 1, 0, 0]


def test_grids_have_the_points_of_the_configuration():
    assert [len(g) for g in (training.LOGISTIC_GRID, training.FOREST_GRID, training.BOOSTING_GRID)] == [3, 24, 16]


@pytest.mark.parametrize("name, grid", [
    ("logistic_regression", [{"C": 0.1}, {"C": 10.0}]),
    ("random_forest", [{"numTrees": 10, "maxDepth": 4, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.5"}]),
    ("hist_gradient_boosting", [{"stepSize": 0.1, "maxDepth": 3, "maxIter": 5, "minInstancesPerNode": 10}]),
])
def test_models_predict_held_out_companies_and_come_back_from_disk(spark, parts, tmp_path, name, grid):
    train, val, test = parts
    trained, row = training.fit_grid(train, val, name, grid, COLUMNS, test=test)
    assert row["model"] == name and row["test_roc_auc"] > 0.95 and row["test_precision"] > 0.8
    trained.save(str(tmp_path / "m"))
    again = training.load(spark, str(tmp_path / "m"))
    assert (again.name, again.threshold, again.columns, again.sectors) == (name, row["threshold"], tuple(COLUMNS), ("Food", "Steel", "it's"))
    before = {r.cin: r.probability for r in trained.applied(test).collect()}
    after = {r.cin: r.probability for r in again.applied(test).collect()}
    assert before == after and len(after) == test.count()
    assert training.leaderboard(spark, [row]).columns[3:] == [f"{p}_{m}" for p in ("val", "test") for m in training.METRICS]


def test_scores_follow_the_model(spark, parts):
    train, val, _ = parts
    trained, row = training.fit_grid(train, val, "logistic_regression", [{"C": 10.0}], COLUMNS)
    assert row["test_f1"] is None
    base = {c: F.lit(None).cast("double") for c in (*scoring.KEY_FIELDS, *scoring.PEER_FEATURES)}
    rules = [r for r in scoring.RULES if r[0] in ("excessive_leverage", "weak_liquidity")]
    rows = spark.createDataFrame([("low", "Food", 2.0, 0.1, 0), ("high", "Food", 2.0, 3.9, 0)], TYPES)
    rows = rows.withColumns({k: v for k, v in base.items() if k not in COLUMNS})
    got = {r.cin: r for r in scoring.score_years(rows, rules=rules, model=trained).collect()}
    assert got["low"].ml_probability < 0.1 and got["high"].ml_probability > 0.9
    assert got["high"].model_threshold == row["threshold"] and got["high"].ml_class == 1
    assert got["high"].model_reasons[0] == "The model weighs debt_to_equity as a risk."
    bare = trained.applied(rows.drop("debt_to_equity"))
    assert bare.count() == 2 and "debt_to_equity" not in bare.columns


def test_names_meet_as_among_all_pairs(spark):
    """A wrong letter anywhere, short words only, and words in another order: the best of all pairs is found."""
    draw = random.Random(3)
    names = ["Infosys Ltd", "LG Ltd", "3M", "A B C Ltd", "Tata Steel Limited", "Reliance Power", "Ltd", "Bharat Foods", "Vijay Mills", "Om"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    asked = [("LG Limited", "x"), ("3m", "y"), ("A B C", "z")]
    for i, name in enumerate(names):
        for j in range(4):
            k = draw.randrange(len(name))
            wrong = name[:k] + draw.choice(letters) + name[k + 1:] if len(name) > 4 and j else name
            asked.append((" ".join(reversed(wrong.split())), f"{i}-{j}"))
    asked.append(("Imfosys", "typo"))
    left = spark.createDataFrame(asked, "company_name string, cin string")
    right = spark.createDataFrame([(str(i), n, i) for i, n in enumerate(names)], "code string, name string, place long")
    got = {r.cin: r.code for r in matching.fuzzy_match_names(left, right).collect()}
    ratio = matching.token_sort_ratio.func
    norm = lambda n: " ".join(n.lower().split())
    found = wanted = 0
    for name, cin in asked:
        scores = [ratio(pd.Series([norm(name)]), pd.Series([norm(n)]))[0] for n in names]
        best = max(scores)
        if best >= 75:
            wanted += 1
            found += got[cin] is not None and scores[int(got[cin])] >= best - 1e-9
    assert wanted >= 35 and found >= 0.9 * wanted
    assert got["x"] == "1" and got["y"] == "2" and got["z"] == "3" and got["typo"] == "0"
