"""The registered queries fit the whole grids, and points fitted side by side give what each gives alone."""

import pytest

from ledgerline.operators import training
from ledgerline.plans.registry import QUERIES

WHOLE = {"logistic_regression": 3, "random_forest": 24, "hist_gradient_boosting": 16}


@pytest.mark.parametrize("query, models", [("leaderboard", list(WHOLE)), ("train_forest", ["random_forest"]), ("train_boosting", ["hist_gradient_boosting"])])
def test_queries_fit_every_point_of_the_configuration(spark, monkeypatch, query, models):
    seen = {}

    def fit(train, val, name, grid, columns, test=None, reference=None, filled=None):
        seen[name] = grid
        row = {c.split()[0]: None for c in training.LEADERBOARD.split(", ")}
        return None, row | {"model": name, "val_pr_auc": 0.5, "val_brier": 0.1}

    monkeypatch.setattr(training, "fit_grid", fit)
    QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    assert {name: len(grid) for name, grid in seen.items()} == {name: WHOLE[name] for name in models}
    if "random_forest" in seen:
        assert {(x["numTrees"], x["maxDepth"]) for x in seen["random_forest"]} == {(200, 10), (200, 15), (300, 10), (300, 15)}
    if "hist_gradient_boosting" in seen:
        assert {x["maxIter"] for x in seen["hist_gradient_boosting"]} == {200, 300}


def test_points_fitted_side_by_side_are_the_same_in_the_grids_order(spark):
    data = [(int(i * 7919 % 101 + i % 13 > 60), "ab"[i % 2], float(i * 31 % 17), float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(data, "target_wilful_default int, sector string, x double, y double")
    grid = [{"stepSize": 0.1, "maxDepth": d, "maxIter": n, "minInstancesPerNode": 10} for d in (1, 2, 3) for n in (2, 4, 6)]  # more points than stand side by side
    alone = [training.fit_grid(df, df, "hist_gradient_boosting", [x], ["x", "y"])[1] for x in grid]
    row = training.fit_grid(df, df, "hist_gradient_boosting", grid, ["x", "y"])[1]
    assert row == max(alone, key=lambda r: (r["val_pr_auc"], -r["val_brier"]))
