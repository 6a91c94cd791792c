"""Incremental scoring: new company-years come as files, and only the companies they touch are scored again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.cohorts import dedupe_first
from ..operators.scoring import score_companies
from ..operators.training import Trained
from ..sources.ledger import Ledger, without

KEYS = ["cin", "financial_year"]


def take_batch(batch: DataFrame, batch_id: int, facts: str, scores: str, threshold: float | None = None, model: Trained | None = None) -> None:
    """Append the batch's new company-years and the new scores of their companies.

    Facts and scores are ledgers in buckets of the company's id: of the history only the batch's buckets are read. Each is
    committed as a whole, so a batch that comes again, after a crash at any place, goes on where it ended and adds nothing
    twice. A year that is there already is passed over. The latest batch's scores of a company count.
    """
    spark = batch.sparkSession
    known = Ledger(spark, facts, "cin", batch.schema)
    before = known.read(known.touched(batch), before=batch_id).select(*batch.columns)
    if not known.committed(batch_id):
        known.append(without(dedupe_first(batch, KEYS, ["company_name"]), [before], KEYS), batch_id)
    new = known.read(only=batch_id).select(*batch.columns)
    touched = new.select("cin").distinct()
    history = before.join(touched, "cin", "left_semi").unionByName(new)
    scored = score_companies(history, threshold, model=model)
    Ledger(spark, scores, "cin", scored.schema).append(scored, batch_id)


def incremental_score(spark: SparkSession, source: str, schema: StructType, facts: str, scores: str, checkpoint: str, threshold: float | None = None, model: Trained | None = None) -> StreamingQuery:
    """Start the job over a folder of Parquet files; it takes what is there, scores it by the model (without one by the stand-in) and ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, i: take_batch(df, i, facts, scores, threshold, model)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, scores: str, schema: StructType) -> DataFrame:
    """The latest scores of each company, with batch_id."""
    rows = Ledger(spark, scores, "cin", schema).read()
    rows = rows.withColumn("batch_id", F.regexp_replace("batch", "c", "").cast("long")).drop("batch", "bucket")
    return dedupe_first(rows, ["cin"], [F.col("batch_id").desc()])
