"""Queries of data quality, selection, splits, training and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import quality, ranges, scoring, selection, training
from ..operators.features import add_row_features
from ..sources.tables import new_path
from . import panel
from .catalog import query
from .queries_features import FEATURES_SQL, ID, IDS, rows
from .queries_lists import COHORT_SQL, both_cohorts
from .queries_scores import P_SQL

CHECKED = ["current_assets", "current_liabilities", "receivables", "capex", "opinion_type", "auditor_name", "promoter_holding_pct", "rpt_count"]
BLANK_SQL = {c: f"({c} IS NULL OR trim({c}::VARCHAR) = '')" for c in CHECKED}
NAMES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in BLANK_SQL.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {FEATURES_SQL} SELECT target_wilful_default, count(*) AS n_rows, count(DISTINCT cin) AS n_companies FROM row_features GROUP BY 1")
def dataset_summary(spark, sf_dir):
    return quality.dataset_summary(rows(spark, sf_dir))


@query(f"""WITH {panel.SQL}, m AS (SELECT company_name, cohort, {NAMES_SQL} AS names FROM company_year)
SELECT company_name, cohort, count(*) AS rows_with_missing, sum(len(names))::BIGINT AS missing_cells, len(list_distinct(flatten(list(names)))) AS distinct_missing_fields,
  array_to_string(list_sort(list_distinct(flatten(list(names)))), '|') AS missing_columns FROM m WHERE len(names) > 0 GROUP BY 1, 2""")
def missingness_summary(spark, sf_dir):
    return quality.missingness_summary(panel.company_years(spark, sf_dir), CHECKED, ["company_name", "cohort"])


@query(f"""WITH {panel.SQL} SELECT company_name, round(1 - avg(len({NAMES_SQL}) / {float(len(CHECKED))}::DOUBLE), 9) AS quality_score, round(1 - avg(len({NAMES_SQL}) / {float(len(CHECKED))}::DOUBLE), 9) < 0.7 AS excluded FROM company_year GROUP BY 1""")
def data_quality_score(spark, sf_dir):
    df = quality.data_quality_score(panel.company_years(spark, sf_dir), CHECKED, ["company_name"])
    return df.select("company_name", F.round("quality_score", 9).alias("quality_score"), (F.round("quality_score", 9) < 0.7).alias("excluded"))


@query(f"""WITH {panel.SQL}, d AS (SELECT 'X' || k % 50 AS cin, fy AS financial_year, (k % 97 = 0)::INT AS label FROM sums)
SELECT 'duplicate_company_year' AS rule, cin || ':' || financial_year AS key, count(*) AS n FROM d GROUP BY cin, financial_year HAVING count(*) > 1
UNION ALL SELECT 'several_labels', cin, count(DISTINCT label) FROM d GROUP BY cin HAVING count(DISTINCT label) > 1""")
def validate_dataset(spark, sf_dir):
    number = F.substring("company_name", -9, 9).cast("long")
    df = panel.company_years(spark, sf_dir).select(F.concat(F.lit("X"), (number % 50).cast("string")).alias("cin"), "financial_year", (number % 97 == 0).cast("int").alias("label"))
    return quality.validate_dataset(df, "label")


@query(f"""WITH {COHORT_SQL} SELECT 'default_year_out_of_range' AS rule, source_row AS row, default_year AS value FROM defaulters WHERE default_year IS NOT NULL AND default_year::INT NOT BETWEEN 2010 AND 2030
UNION ALL SELECT 'fy_before_default_missing', source_row, fy_before_default FROM defaulters WHERE fy_before_default IS NULL
UNION ALL SELECT 'row_count', NULL, count(*)::VARCHAR FROM defaulters HAVING count(*) <> 50""")
def validate_cohorts(spark, sf_dir):
    return quality.validate_cohorts(both_cohorts(spark, sf_dir)[0], "defaulter", 50)


@query(f"""WITH {panel.SQL} SELECT 'duplicate_company_year' AS rule, count(*) AS n FROM (SELECT cin, financial_year FROM company_year GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'blank:sector', count(*) FROM company_year WHERE trim(coalesce(sector, '')) = '' HAVING count(*) > 0
UNION ALL SELECT 'several_companies', count(DISTINCT cin) FROM company_year HAVING count(DISTINCT cin) > 1""")
def validate_scoring_input(spark, sf_dir):
    return quality.validate_scoring_input(panel.company_years(spark, sf_dir), single_company=True)


@query(f"WITH {panel.SQL} SELECT cin, financial_year, {' + '.join(f'(NOT {t})::INT' for t in BLANK_SQL.values())} AS filled FROM company_year")
def fill_rate(spark, sf_dir):
    return panel.company_years(spark, sf_dir).select("cin", "financial_year", quality.fill_rate(CHECKED).alias("filled"))


PARTS_SQL = {"l_quantity": "l_quantity", "part": "CASE WHEN l_quantity > 5 THEN l_tax * 0 END", "one": "1", "gone": "NULL::DOUBLE"}


@query("SELECT feature FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, count(DISTINCT {v}) + max(({v} IS NULL)::INT) AS n FROM lineitem" for k, v in PARTS_SQL.items()) + ") WHERE n <= 1")
def constant_columns(spark, sf_dir):
    df = panel.table(spark, sf_dir, "lineitem").select("l_quantity", F.when(F.col("l_quantity") > 5, F.col("l_tax") * 0).alias("part"), F.lit(1).alias("one"), F.lit(None).cast("double").alias("gone"))
    return quality.constant_columns(df, ["l_quantity", "part", "one", "gone"])


CORRELATED = ["revenue", "total_assets", "pat", "cfo", "current_ratio", "debt_to_equity", "capex"]
PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]


def pair_sql(a: str, b: str) -> str:
    """Pairwise-complete moments; a variance that is 0 gives null."""
    both = f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    n = "count(*)::DOUBLE"
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN ({n} * sum({a} * {a}) - sum({a}) * sum({a})) > 0 AND ({n} * sum({b} * {b}) - sum({b}) * sum({b})) > 0 "
        f"THEN round(abs(corr({a}, {b})), 6) END AS r FROM row_features {both}"
    )


CORR_SQL = f"{FEATURES_SQL}, pairs AS ({' UNION ALL '.join(pair_sql(a, b) for a, b in PAIRS)})"


def correlations(spark, sf_dir):
    return selection.correlation_matrix(rows(spark, sf_dir), CORRELATED)


@query(f"WITH {CORR_SQL} SELECT * FROM pairs")
def correlation_matrix(spark, sf_dir):
    return correlations(spark, sf_dir).withColumn("r", F.round("r", 6))


@query(f"WITH {CORR_SQL} SELECT DISTINCT b AS feature FROM pairs WHERE r > 0.9")
def correlation_filter(spark, sf_dir):
    return selection.correlation_filter(correlations(spark, sf_dir))


IMPUTED = ["revenue", "current_ratio", "debt_to_equity", "capex"]


@query(f"WITH {FEATURES_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median FROM row_features" for c in IMPUTED))
def median_impute_stats(spark, sf_dir):
    return quality.median_impute_stats(rows(spark, sf_dir), IMPUTED)


@query(f"WITH {panel.SQL} " + " UNION ALL ".join(f"(SELECT '{c}' AS feature, {c} AS mode FROM company_year WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ("sector", "opinion_type", "auditor_name")))
def mode_impute_stats(spark, sf_dir):
    return quality.mode_impute_stats(panel.company_years(spark, sf_dir), ["sector", "opinion_type", "auditor_name"])


@query(f"""WITH {panel.SQL}, m AS (SELECT sector, financial_year, median(capex) AS m FROM company_year GROUP BY ALL) SELECT company_name, financial_year, coalesce(capex, m) AS capex_imputed FROM company_year LEFT JOIN m USING (sector, financial_year)""")
def sector_median_impute(spark, sf_dir):
    return quality.sector_median_impute(panel.company_years(spark, sf_dir), ["capex"]).select("company_name", "financial_year", "capex_imputed")


PRINTED = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
LANE_SQL = ", ".join(f"(sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) % 18446744073709551616)::VARCHAR" for i in range(quality.LANES))


@query(f"""WITH d AS (SELECT sha256({' || '.join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in PRINTED)}) AS d FROM customer)
SELECT count(*) AS n_rows, sha256(concat_ws(':', count(*)::VARCHAR, {LANE_SQL})) AS fingerprint FROM d""")
def dataset_fingerprint(spark, sf_dir):
    """The fingerprint of the customers, merged from those of their fifths."""
    df = panel.table(spark, sf_dir, "customer").select(*PRINTED)
    parts = [quality.fingerprint_lanes(df.filter(F.pmod("c_custkey", F.lit(5)) == i)) for i in range(5)]
    lanes = quality.merged_lanes(reduce(DataFrame.unionByName, parts))
    return lanes.select(F.col("n").alias("n_rows"), F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"lane_{i}").cast("string") for i in range(quality.LANES)]), 256).alias("fingerprint"))


@query("""SELECT r_name AS bank, c_mktsegment AS sector, 2010 + c_custkey % 5 AS year, count(*) AS n_defaulters, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS amount
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0 GROUP BY ROLLUP (r_name, c_mktsegment, 2010 + c_custkey % 5)""")
def lender_sector_exposure(spark, sf_dir):
    nations = panel.table(spark, sf_dir, "nation").join(panel.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = panel.table(spark, sf_dir, "customer").filter("c_acctbal < 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return quality.lender_sector_exposure(people.select(F.col("r_name").alias("bank"), F.col("c_mktsegment").alias("sector"), (2010 + F.col("c_custkey") % 5).alias("year"), "c_acctbal"), "bank", "sector", "c_acctbal", "year")


SHARE_SQL = "('0x' || substr(md5(cin || ':42'), 1, 7))::BIGINT / 268435456.0::DOUBLE"
SPLIT_SQL = f"CASE WHEN {SHARE_SQL} < 0.7 THEN 'train' WHEN {SHARE_SQL} < 0.85 THEN 'val' ELSE 'test' END"


@query(f"WITH {panel.SQL} SELECT cin, financial_year, {SPLIT_SQL} AS split FROM company_year")
def company_split_by_hash(spark, sf_dir):
    return selection.company_split(panel.company_years(spark, sf_dir)).select("cin", "financial_year", "split")


STRATIFIED_SQL = f"""{panel.SQL}, companies AS (SELECT cin, max(cohort) AS label FROM company_year GROUP BY 1),
placed AS (SELECT cin, row_number() OVER (PARTITION BY label ORDER BY md5(cin || ':42'), cin) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM companies),
splits AS (SELECT cin, CASE WHEN place < floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN place < floor(n * 0.85::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM placed)"""


@query(f"WITH {STRATIFIED_SQL} SELECT cin, financial_year, split FROM company_year JOIN splits USING (cin)")
def company_split(spark, sf_dir):
    return selection.stratified_split(panel.company_years(spark, sf_dir), "cohort").select("cin", "financial_year", "split")


@query(f"WITH {STRATIFIED_SQL} SELECT split, cohort, count(DISTINCT cin) AS n_companies, count(*) AS n_rows FROM company_year JOIN splits USING (cin) GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    return selection.split_counts(selection.stratified_split(panel.company_years(spark, sf_dir), "cohort"), "cohort")


@query(f"""WITH {panel.SQL}, v AS (SELECT cin, financial_year, sector, floor(revenue / 20000) AS size FROM company_year)
SELECT *, rank() OVER w AS rank, percent_rank() OVER w AS percent_rank, count(*) OVER (PARTITION BY sector) AS group_rows FROM v WINDOW w AS (PARTITION BY sector ORDER BY size DESC)""")
def rank_within_sector(spark, sf_dir):
    """Company-years by size within their sector, many of them tied."""
    df = panel.company_years(spark, sf_dir).select("cin", "financial_year", "sector", F.floor(F.col("revenue") / 20000).cast("double").alias("size"))
    return ranges.rank_within(df, "sector", "size")


@query(f"WITH {panel.SQL} SELECT cin, financial_year, revenue FROM company_year WHERE cin IN (SELECT cin FROM (SELECT DISTINCT cin, {SPLIT_SQL} AS split FROM company_year) WHERE split = 'val')")
def split_membership(spark, sf_dir):
    df = panel.company_years(spark, sf_dir)
    members = selection.company_split(df).filter("split = 'val'").select("cin").distinct()
    return df.join(members, "cin", "left_semi").select("cin", "financial_year", "revenue")


@query(f"""WITH {panel.SQL}, d AS (SELECT cin, financial_year, CASE WHEN cohort = 'defaulter' THEN 1995 + ascii(right(cin, 1)) % 6 END AS default_year FROM company_year)
SELECT cin, financial_year, CASE WHEN coalesce(min(default_year) OVER (PARTITION BY cin) <= 1997, {SHARE_SQL} < 0.7) THEN 'train' ELSE 'test' END AS split FROM d""")
def temporal_split(spark, sf_dir):
    df = panel.company_years(spark, sf_dir).withColumn("default_year", F.when(F.col("cohort") == "defaulter", 1995 + F.ascii(F.right("cin", F.lit(1))) % 6))
    return selection.temporal_split(df, 1997).select("cin", "financial_year", "split")


@query(f"WITH {panel.SQL} SELECT cin, financial_year FROM company_year WHERE cohort <> 'defaulter' OR financial_year <= 2001 - 3")
def leakage_cutoff(spark, sf_dir):
    df = panel.company_years(spark, sf_dir).withColumn("default_year", F.when(F.col("cohort") == "defaulter", 2001))
    return selection.leakage_cutoff(df).select("cin", "financial_year")


def scores(spark, sf_dir):
    """Labels and a probability at four places, so that there are ties."""
    return rows(spark, sf_dir).select(F.col("target_wilful_default").alias("y"), F.bround(scoring.stand_in_probability(), 4).alias("p"))


SCORES_SQL = f"{FEATURES_SQL}, s AS (SELECT target_wilful_default AS y, round_even({P_SQL}, 4) AS p FROM row_features)"
GRID_SQL = f"""{SCORES_SQL}, g AS (SELECT (g / 100.0)::DOUBLE AS threshold FROM range(10, 91) r(g)),
c AS (SELECT threshold, count(*) FILTER (WHERE y = 1 AND floor(round(p * 100, 6)) >= round(threshold * 100)) AS tp, count(*) FILTER (WHERE y = 0 AND floor(round(p * 100, 6)) >= round(threshold * 100)) AS fp, sum(y) AS pos FROM s, g GROUP BY 1),
t AS (SELECT threshold, tp, fp, pos, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(pos, 0), 0) AS recall FROM c),
u AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM t)"""


@query(f"WITH {GRID_SQL} SELECT threshold, precision, recall, f1 FROM u")
def threshold_table(spark, sf_dir):
    return ev.threshold_table(scores(spark, sf_dir))


@query(f"""WITH {GRID_SQL}, best AS (SELECT *, 1 AS o FROM (SELECT * FROM u WHERE recall >= 0.75 ORDER BY precision DESC, f1 DESC, threshold LIMIT 1) UNION ALL
SELECT *, 2 FROM (SELECT * FROM u ORDER BY f1 DESC, precision DESC, recall DESC, threshold LIMIT 1)) SELECT threshold, precision, recall, f1 FROM best ORDER BY o LIMIT 1""")
def threshold_select(spark, sf_dir):
    return ev.threshold_select(scores(spark, sf_dir))


@query(f"WITH {GRID_SQL} SELECT threshold, (100e6 * (pos - tp) + 1e6 * fp)::DOUBLE AS cost FROM u ORDER BY cost, threshold LIMIT 1")
def cost_weighted_threshold(spark, sf_dir):
    return ev.cost_weighted_threshold(scores(spark, sf_dir))


@query(f"""WITH {SCORES_SQL}, c AS (SELECT count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, round(avg((p - y) * (p - y)), 9) AS brier FROM s),
r AS (SELECT *, (tp + tn) / (tn + fp + fn + tp) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM c)
SELECT * EXCLUDE (s), (recall + s) / 2 AS balanced_accuracy FROM r""")
def confusion_metrics(spark, sf_dir):
    return ev.confusion_metrics(scores(spark, sf_dir), 0.5).withColumn("brier", F.round("brier", 9))


DISTINCT_SQL = f"{SCORES_SQL}, d AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY 1), w AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, coalesce(sum(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nabove FROM d)"


@query(f"WITH {DISTINCT_SQL} SELECT round(sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM w")
def roc_auc(spark, sf_dir):
    return ev.roc_auc(scores(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"WITH {DISTINCT_SQL} SELECT round(sum(pos * ((above + pos) / (above + pos + nabove + neg))) / sum(pos), 9) AS average_precision FROM w")
def average_precision(spark, sf_dir):
    return ev.average_precision(scores(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {SCORES_SQL} SELECT y, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM s GROUP BY y")
def class_weights(spark, sf_dir):
    return ev.class_weights(scores(spark, sf_dir))


def grid_results(spark, sf_dir):
    """Orders as results of a grid: models, PR-AUC and Brier scores with ties."""
    o = panel.table(spark, sf_dir, "orders")
    model = F.when(F.col("o_orderkey") % 3 == 0, "logistic_regression").when(F.col("o_orderkey") % 3 == 1, "random_forest").otherwise("hist_gradient_boosting")
    return o.select(model.alias("model"), F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") * 7919) % 1000 / 1000).alias("pr_auc"), ((F.col("o_orderkey") * 31) % 100 / 100).alias("brier"))


GRID_RESULTS_SQL = """results AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'random_forest' ELSE 'hist_gradient_boosting' END AS model, o_orderkey AS seq,
  ((o_orderkey * 7919) % 1000) / 1000 AS pr_auc, ((o_orderkey * 31) % 100) / 100 AS brier FROM orders),
best AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY model ORDER BY pr_auc DESC, brier, seq) = 1)"""


@query(f"WITH {GRID_RESULTS_SQL} SELECT * FROM best")
def pick_best_params(spark, sf_dir):
    return ev.pick_best_params(grid_results(spark, sf_dir))


@query(f"""WITH {GRID_RESULTS_SQL} SELECT model, pr_auc AS val_pr_auc, brier AS val_brier FROM best WHERE pr_auc >= (SELECT max(pr_auc) FROM best) - 0.02
ORDER BY brier, CASE model WHEN 'logistic_regression' THEN 1 WHEN 'random_forest' THEN 2 ELSE 3 END LIMIT 1""")
def choose_production(spark, sf_dir):
    board = ev.pick_best_params(grid_results(spark, sf_dir)).select("model", F.col("pr_auc").alias("val_pr_auc"), F.col("brier").alias("val_brier"))
    return ev.choose_production(board)


INPUTS = ["current_ratio", "debt_to_assets", "interest_coverage", "net_profit_margin", "cash_flow_to_debt", "equity_ratio"]


#: The configuration's grids, which the registered queries fit whole.
GRIDS = {"logistic_regression": training.LOGISTIC_GRID, "random_forest": training.FOREST_GRID, "hist_gradient_boosting": training.BOOSTING_GRID}


def parted(features):
    """Labels, sectors, inputs and peer features of company-years with their split, made once for all models of a query."""
    shown = dict.fromkeys([*INPUTS, *scoring.PEER_FEATURES])
    df = selection.company_split(features).select("target_wilful_default", "sector", "split", *shown)
    return ranges.stored(df, "split-rows")


def fitted(df, name, grid, reference=False, filled=None):
    """The grid's choice over rows of parted(); with `reference` it holds the training companies' sector medians."""
    train, val, test = (df.filter(F.col("split") == x) for x in ("train", "val", "test"))
    narrow = lambda x: x.select("target_wilful_default", "sector", *INPUTS)
    return training.fit_grid(narrow(train), narrow(val), name, grid, INPUTS, test=narrow(test), reference=scoring.sector_reference(train) if reference else None, filled=filled)


@query()
def train_logistic(spark, sf_dir):
    """The leaderboard row of the logistic grid, chosen on validation companies."""
    return training.leaderboard(spark, [fitted(parted(rows(spark, sf_dir)), "logistic_regression", training.LOGISTIC_GRID)[1]])


@query()
def train_forest(spark, sf_dir):
    """The leaderboard row of the forest's grid, chosen on validation companies."""
    return training.leaderboard(spark, [fitted(parted(rows(spark, sf_dir)), "random_forest", training.FOREST_GRID)[1]])


@query()
def train_boosting(spark, sf_dir):
    """The leaderboard row of the boosting grid, chosen on validation companies."""
    return training.leaderboard(spark, [fitted(parted(rows(spark, sf_dir)), "hist_gradient_boosting", training.BOOSTING_GRID)[1]])


@query()
def leaderboard(spark, sf_dir):
    """All three models with their validation and test metrics, and which one goes to production."""
    df = parted(rows(spark, sf_dir))
    filled = training.imputer(df.filter("split = 'train'"), INPUTS)
    results = [fitted(df, name, grid, filled=filled)[1] for name, grid in GRIDS.items()]
    chosen = training.production(spark, results).select(F.col("model").alias("chosen"))
    board = training.leaderboard(spark, results)
    return board.join(chosen, F.col("model") == F.col("chosen"), "left").withColumn("production", F.col("chosen").isNotNull()).drop("chosen")


@query()
def feature_diagnostics(spark, sf_dir):
    """The coefficients of the logistic model that the grid's choice on validation companies gives, by size."""
    return training.feature_diagnostics(spark, fitted(parted(rows(spark, sf_dir)), "logistic_regression", training.LOGISTIC_GRID)[0])


@query()
def score_with_model(spark, sf_dir):
    """Every company scored by the logistic model of the training companies, which is saved and loaded in between."""
    path, years = new_path(spark, "model"), ranges.stored(panel.company_years(spark, sf_dir), "company-years")
    fitted(parted(add_row_features(years)), "logistic_regression", training.LOGISTIC_GRID, reference=True)[0].save(path)
    scores = scoring.score_companies(years, model=training.load(spark, path))
    return scores.select("cin", "model_name", "latest_financial_year", "years_received", "ml_probability", "model_threshold", "risk_band", F.array_join("top_reasons", " | ").alias("top_reasons"), F.array_join("warnings", " | ").alias("warnings"))


SHOWN = ["current_ratio", "net_profit_margin"]
PREPROCESS_SQL = f"""{FEATURES_SQL}, parted AS (SELECT *, {SPLIT_SQL} AS split FROM row_features),
known AS (SELECT {', '.join(f"median({c}) AS m_{c}" for c in SHOWN)} FROM parted WHERE split = 'train'),
filled AS (SELECT {IDS}, split, {', '.join(f"coalesce({c}, m_{c}) AS {c}" for c in SHOWN)} FROM parted, known),
spread AS (SELECT {', '.join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS d_{c}" for c in SHOWN)} FROM filled WHERE split = 'train')"""


@query(f"WITH {PREPROCESS_SQL} SELECT {IDS}, {', '.join(f'round(({c} - a_{c}) / d_{c}, 6) AS {c}' for c in SHOWN)} FROM filled, spread")
def preprocess(spark, sf_dir):
    """Two inputs of all company-years after imputing by the training medians and scaling by the training spread."""
    df = selection.company_split(rows(spark, sf_dir))
    model = training.preprocess(df.filter("split = 'train'"), SHOWN)
    vector = vector_to_array(F.col("features"))
    return model.transform(df).select(*ID, *[F.round(vector[i], 6).alias(c) for i, c in enumerate(SHOWN)])
