"""Model evaluation over (label, probability) rows: distinct scores are counted first, prefix sums run over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE_ROWS, prefix_sums

PRIORITY = {"logistic_regression": 1, "random_forest": 2, "hist_gradient_boosting": 3, "gradient_boosting": 3}


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.select(label, (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"))


def threshold_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall and F1 at the thresholds 0.10 to 0.90. Each row falls in one bucket; 81 rows get running sums."""
    bucket = F.least(F.greatest(F.floor(F.round(F.col(p) * 100, 6)), F.lit(9)), F.lit(90)).cast("int")
    counts = df.groupBy(bucket.alias("b")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    grid = df.sparkSession.range(9, 91).select(F.col("id").cast("int").alias("g"))
    rows = grid.join(counts, F.col("g") == F.col("b"), "left")
    above = Window.orderBy(F.col("g").desc())
    whole = Window.partitionBy()
    rows = rows.select("g", F.sum(F.coalesce("pos", F.lit(0))).over(above).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(above).alias("fp"), F.sum(F.coalesce("pos", F.lit(0))).over(whole).alias("p_all"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("p_all")), F.lit(0.0))
    rows = rows.filter("g >= 10").select((F.col("g") / 100).alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def threshold_select(df: DataFrame, y: str = "y", p: str = "p", least_recall: float = 0.75) -> DataFrame:
    """The threshold with the best precision among those with enough recall, else with the best F1."""
    rows = threshold_table(df, y, p)
    enough = F.col("recall") >= least_recall
    down = (-F.col("threshold")).alias("d")
    best = F.max(F.when(enough, F.struct("precision", F.col("f1").alias("second"), down, "threshold", "recall", "f1")))
    fallback = F.max(F.struct("f1", "precision", "recall", down, "threshold"))
    row = rows.agg(best.alias("a"), fallback.alias("b"))
    return row.select(*[F.when(F.col("a").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("threshold", "precision", "recall", "f1")])


def cost_weighted_threshold(df: DataFrame, y: str = "y", p: str = "p", miss: float = 100e6, alarm: float = 1e6) -> DataFrame:
    """The threshold with the least cost of misses and false alarms, the lowest of equals."""
    rows = threshold_table(df, y, p)
    counts = df.agg(F.sum(F.col(y).cast("long")).alias("pos"))
    rows = rows.join(F.broadcast(counts))  # one row
    tp = F.round(F.col("recall") * F.col("pos")).cast("long")
    fp = F.when(F.col("precision") > 0, F.round(tp / F.col("precision") - tp)).otherwise(0).cast("long")
    cost = miss * (F.col("pos") - tp) + alarm * fp
    return rows.withColumn("cost", cost.cast("double")).agg(F.min(F.struct("cost", "threshold")).alias("x")).select("x.threshold", "x.cost")


def confusion_metrics(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """One row: the confusion counts and what follows from them; 0 where undefined."""
    label, hit = F.col(y) == 1, F.col(p) >= threshold
    row = df.agg(
        F.count_if(~label & ~hit).alias("tn"), F.count_if(~label & hit).alias("fp"), F.count_if(label & ~hit).alias("fn"), F.count_if(label & hit).alias("tp"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return row.withColumns({
        "accuracy": ratio(tp + tn, tn + fp + fn + tp), "precision": precision, "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + ratio(tn, tn + fp)) / 2,
    })


def score_counts(df: DataFrame, y: str = "y", p: str = "p", rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Per distinct score: positives and negatives, and those with a higher score, by prefix sums over sampled ranges of the scores."""
    counts = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    rows = prefix_sums(counts, [], ["p"], ["pos", "neg"], rows_per_range)
    above = lambda c: (F.col(f"{c}_total") - F.col(f"{c}_before") - F.col(c)).alias(f"{c}_above")
    return rows.select("p", "pos", "neg", above("pos"), above("neg"), F.col("pos_total").alias("all_pos"), F.col("neg_total").alias("all_neg"))


def _area() -> Column:
    return F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)), F.max("all_pos") * F.max("all_neg"))


def _precision_steps() -> Column:
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return F.try_divide(F.sum(F.col("pos") * (tp / (tp + fp))), F.max("all_pos"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve; ties count half."""
    return score_counts(df, y, p).agg(_area().alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Sum over scores, from the highest, of the step in recall times the precision."""
    return score_counts(df, y, p).agg(_precision_steps().alias("average_precision"))


def areas(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: average_precision and roc_auc by one pass over the counted scores."""
    return score_counts(df, y, p).agg(_precision_steps().alias("average_precision"), _area().alias("roc_auc"))


def pick_best_params(results: DataFrame) -> DataFrame:
    """Per model the parameters with the best PR-AUC, then the least Brier score, then the first (results: model, seq, pr_auc, brier)."""
    order = Window.partitionBy("model").orderBy(F.col("pr_auc").desc(), "brier", "seq")
    return results.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def choose_production(leaderboard: DataFrame, within: float = 0.02) -> DataFrame:
    """Of the models close to the best validation PR-AUC, that with the least Brier score, then by priority."""
    best = F.max("val_pr_auc").over(Window.partitionBy())
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("model")), F.lit(99))
    rows = leaderboard.withColumn("__best", best).filter(F.col("val_pr_auc") >= F.col("__best") - within)
    return rows.orderBy("val_brier", rank).limit(1).drop("__best")
