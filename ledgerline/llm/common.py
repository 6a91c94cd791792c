"""What the text operators share: words, shared folders, distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Spark's setting for deleting shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, in local mode only, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return f"file://{_own_folders[app]}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: a cut of the lineage that outlives executors.

    What follows reads the files, so Spark is asked to delete the shuffle files of the writing plan when it ends.
    """
    spark = df.sparkSession
    path, before = new_path(spark, what), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a table from written() that no later plan reads."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def own_prefix(df: DataFrame) -> str:
    """Underscores, more than any column of df begins with, for names that clash with none of them."""
    return "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; null text has none. Every word run becomes one character, every gap none."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), GAP, "")).cast("long")


def text_key(text: Column) -> Column:
    """128-bit key of a text's content, null apart from every text."""
    return F.unhex(F.md5(F.when(text.isNull(), F.lit("\x00null")).otherwise(F.concat(F.lit("t"), text)).cast("binary")))


def prefix_offsets(totals: DataFrame, group: list[str], bucket: str, total: str) -> DataFrame:
    """Per (group, bucket), the sum of `total` over the group's earlier buckets, as `offset`, and over all of them, as `group_total`.

    A group has at most as many rows here as there are buckets, however many rows it had before.
    """
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({
        "offset": F.coalesce(F.sum(total).over(earlier), F.lit(0)),
        "group_total": F.sum(total).over(Window.partitionBy(*group)),
    })
