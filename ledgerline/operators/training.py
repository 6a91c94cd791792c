"""Model training with pyspark.ml under the reference's contract: grouped splits, class weights, grids, leaderboard."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import batched, product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import areas, average_precision, choose_production, confusion_metrics, threshold_select
from .quality import median_impute_stats

#: Grids: fixed values, under pyspark.ml's names of the parameters.
LOGISTIC_GRID = [{"C": c} for c in (0.1, 1.0, 10.0)]
FOREST_GRID = [
    {"numTrees": n, "maxDepth": d, "minInstancesPerNode": m, "featureSubsetStrategy": f}
    for n, d, m, f in product((200, 300), (10, 15), (1, 2, 4), ("sqrt", "0.5"))
]
BOOSTING_GRID = [{"stepSize": s, "maxDepth": d, "maxIter": n, "minInstancesPerNode": m} for s, d, n, m in product((0.05, 0.1), (3, 5), (200, 300), (10, 20))]

#: Points of a grid that are fitted side by side: boosting is a long chain of small jobs, a forest fills the cores by itself.
AT_ONCE = {"logistic_regression": 3, "random_forest": 1, "hist_gradient_boosting": 8}

MOST_INPUTS = 10_000
CATEGORY = "__category"


@dataclass(frozen=True)
class Trained:
    """A fitted model and what scoring by it needs: the threshold, the inputs and their names, the training sectors and medians."""

    name: str
    model: PipelineModel
    threshold: float
    columns: tuple[str, ...]
    names: tuple[str, ...]
    sectors: tuple[str, ...]
    reference: DataFrame | None = None

    def applied(self, df: DataFrame, limit: int = 3) -> DataFrame:
        """df with `probability` and, from a linear model, `model_reasons`: the inputs that add most to the score.

        A column of the model that df lacks counts as null, so it takes the training median. No shuffle.
        """
        kept = df.columns
        rows = self.model.transform(df.withColumns({c: F.lit(None).cast("double") for c in self.columns if c not in kept}))
        out = {"probability": vector_to_array("probability")[1]}
        last = self.model.stages[-1]
        if hasattr(last, "coefficients"):
            weights = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(n).alias("n")) for w, n in zip(last.coefficients.toArray(), self.names)])
            parts = F.zip_with(vector_to_array("features"), weights, lambda x, y: F.struct((x * y["w"]).alias("share"), y["n"].alias("feature")))
            worst = F.slice(F.sort_array(F.filter(parts, lambda x: x["share"] > 0), asc=False), 1, limit)
            out["model_reasons"] = F.transform(worst, lambda x: F.concat(F.lit("The model weighs "), x["feature"], F.lit(" as a risk.")))
        return rows.select(*[c for c in kept if c not in out], *[v.alias(k) for k, v in out.items()])

    def save(self, path: str) -> None:
        """Write the model under path; the row of settings comes last, so a folder without it is not a whole model."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/pipeline")
        if self.reference is not None:
            self.reference.write.mode("overwrite").parquet(f"{path}/reference")
        row = (self.name, self.threshold, list(self.columns), list(self.names), list(self.sectors), self.reference is not None)
        spark.createDataFrame([row], SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")


SETTINGS = "name string, threshold double, columns array<string>, names array<string>, sectors array<string>, reference boolean"


def load(spark: SparkSession, path: str) -> Trained:
    """The model that save() wrote under path."""
    row = spark.read.schema(SETTINGS).parquet(f"{path}/settings").first()
    reference = spark.read.parquet(f"{path}/reference") if row["reference"] else None
    return Trained(row["name"], PipelineModel.load(f"{path}/pipeline"), row["threshold"], tuple(row["columns"]), tuple(row["names"]), tuple(row["sectors"]), reference)


def number(x: float | None) -> str:
    return f"CAST({float(x or 0.0)!r} AS DOUBLE)"


def imputer(train: DataFrame, columns: list[str], category: str | None = "sector") -> SQLTransformer:
    """A stage that fills null inputs with the training medians and a blank category with the most frequent one.

    It adds columns `__in_<input>` and, with a category, `__category`; the settings are one value an input.
    """
    if len(columns) > MOST_INPUTS:
        raise ValueError(f"a model takes {MOST_INPUTS} inputs at most")
    known = {r["feature"]: r["median"] for r in median_impute_stats(train, columns).collect()}
    filled = [f"COALESCE(CAST(`{c}` AS DOUBLE), {number(known.get(c))}) AS `__in_{c}`" for c in columns]
    if category:
        there = train.select(F.trim(F.col(category)).alias("v")).filter("v <> ''").groupBy("v").count()
        mode = there.orderBy(F.col("count").desc(), "v").first()
        usual = (mode["v"] if mode else "none").replace("\\", "\\\\").replace("'", "\\'")
        filled.append(f"COALESCE(NULLIF(TRIM(`{category}`), ''), '{usual}') AS `{CATEGORY}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def preprocessor(columns: list[str], category: str | None = "sector", scale: bool = True) -> list:
    """Stages from imputed inputs to a vector `features`: numbers, scaled for linear models, then the category one-hot, unknown ones all zero."""
    stages, parts = [VectorAssembler(inputCols=[f"__in_{c}" for c in columns], outputCol="__numbers")], ["__numbers"]
    if scale:
        stages.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True))
        parts = ["__scaled"]
    if category:
        stages += [
            StringIndexer(inputCol=CATEGORY, outputCol="__index", handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCol="__index", outputCol="__onehot", dropLast=True, handleInvalid="error"),
        ]
        parts.append("__onehot")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def preprocess(train: DataFrame, columns: list[str], category: str | None = "sector", scale: bool = True, filled: SQLTransformer | None = None) -> PipelineModel:
    """The fitted imputing, scaling and encoding of the training rows; `filled` is their imputer if it is known already."""
    return Pipeline(stages=[filled or imputer(train, columns, category), *preprocessor(columns, category, scale)]).fit(train)


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """df with balanced class weights; the counts are two numbers."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total, weight = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def classifier(name: str, params: dict, label: str, total_weight: float, seed: int = 42):
    common = {"labelCol": label, "featuresCol": "features", "weightCol": "weight"}
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (params["C"] * total_weight), elasticNetParam=0.0, standardization=False, maxIter=200, **common)
    if name == "random_forest":
        return RandomForestClassifier(seed=seed, **params, **common)
    if name == "hist_gradient_boosting":
        return GBTClassifier(seed=seed, **params, **common)
    raise ValueError(f"no model is named {name}")


def fitted_points(ready: DataFrame, name: str, grid: list[dict], label: str, total_weight: float):
    """Each point of the grid with its fitted classifier, in order. AT_ONCE of them are in the driver's memory at a time."""
    fit = inheritable_thread_target(ready.sparkSession)(lambda params: classifier(name, params, label, total_weight).fit(ready))
    with ThreadPool(AT_ONCE[name]) as pool:
        for some in batched(grid, AT_ONCE[name]):
            yield from zip(some, pool.map(fit, some, chunksize=1))


def scored(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    return model.transform(df).select(F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def metrics(rows: DataFrame, threshold: float, prefix: str) -> dict:
    """PR-AUC, ROC-AUC, Brier score, precision, recall and F1 of (y, p) rows at a threshold."""
    at, area = confusion_metrics(rows, threshold).first(), areas(rows).first()
    found = {"pr_auc": area["average_precision"], "roc_auc": area["roc_auc"], "brier": at["brier"], "precision": at["precision"], "recall": at["recall"], "f1": at["f1"]}
    return {f"{prefix}_{k}": v for k, v in found.items()}


def fit_grid(
    train: DataFrame, val: DataFrame, name: str, grid: list[dict], columns: list[str], label: str = "target_wilful_default", category: str | None = "sector",
    test: DataFrame | None = None, reference: DataFrame | None = None, filled: SQLTransformer | None = None,
) -> tuple[Trained, dict]:
    """The model of the grid with the best (PR-AUC, -Brier) on val, the first of equals, and its leaderboard row.

    The threshold is chosen on val; the test metrics are null without test rows. Several grids over the same training
    rows can share their imputer. The rows are read many times, so they should be stored.
    """
    train, val = with_weights(train, label).cache(), val.cache()
    weight = train.agg(F.sum("weight")).first()[0]
    front = preprocess(train, columns, category, scale=name == "logistic_regression", filled=filled)
    ready = front.transform(train).select(label, "features", "weight").cache()
    best = None
    for params, last in fitted_points(ready, name, grid, label, weight):
        model = PipelineModel(front.stages + [last])
        rows = scored(model, val, label).cache()
        pr = average_precision(rows).first()[0] or 0.0
        brier = confusion_metrics(rows, 0.5).first()["brier"]
        if best is None or (pr, -brier) > best[0]:
            if best is not None:
                best[3].unpersist()
            best = ((pr, -brier), model, params, rows)
        else:
            rows.unpersist()
    model, params, rows = best[1:]
    threshold = threshold_select(rows).first()["threshold"]
    row = {"model": name, "params": str(params), "threshold": threshold, **metrics(rows, threshold, "val")}
    rows.unpersist()
    if test is None:
        row |= {f"test_{k}": None for k in METRICS}
    else:
        rows = scored(model, test, label).cache()
        row |= metrics(rows, threshold, "test")
        rows.unpersist()
    labels = [x for x in next((s.labels for s in model.stages if hasattr(s, "labels")), [])]
    for x in (ready, train, val):
        x.unpersist()
    names = [*columns, *[f"{category}={x}" for x in labels]]
    return Trained(name, model, row["threshold"], tuple(columns), tuple(names), tuple(labels), reference), row


METRICS = ("pr_auc", "roc_auc", "brier", "precision", "recall", "f1")
LEADERBOARD = "model string, params string, threshold double, " + ", ".join(f"{part}_{m} double" for part in ("val", "test") for m in METRICS)


def leaderboard(spark, results: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in LEADERBOARD.split(", ")) for r in results], LEADERBOARD)


def production(spark, results: list[dict]) -> DataFrame:
    return choose_production(leaderboard(spark, results))


def feature_diagnostics(spark, trained: Trained) -> DataFrame:
    """(feature, value): coefficients by size, or importances, largest first."""
    last = trained.model.stages[-1]
    values = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(trained.names, values)], "feature string, value double").orderBy(F.abs("value").desc())
