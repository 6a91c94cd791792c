"""Reading and writing of company lists, company-years and scoring payloads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import normalize_cin, normalize_text, number
from ..plans.panel import COLUMNS, NUMERIC
from .company_files import read_files
from .ledger import first_by_all, without

#: Headers of company lists and what they mean: fixed values.
LIST_ALIASES = {
    "company_name": ("company name", "company_name", "borrower name", "borrower", "name of borrower", "name"),
    "cin": ("cin", "corporate identification number", "company registration number", "registration number", "company id"),
}
#: More spellings of the same, of this library's own.
MORE_ALIASES = {"company_name": ("company",), "cin": ("cin number", "cin no", "company cin")}
#: Texts of a CSV that mean a missing value: fixed values.
NULL_TOKENS = ("", "NA", "N/A", "nan", "NaN", "null", "NULL", "None", "n/a", "-nan", "#N/A")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; in local mode only, a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_company_list(spark: SparkSession, path: str, company_name_column: str | None = None, cin_column: str | None = None, encoding: str | None = None, places: bool = False) -> DataFrame:
    """(company_name, cin, source_row) of CSV files, each by its own header and encoding; rows without a name go. With places, file and file_row as well.

    file_row numbers the rows of a file from 0 before any goes, source_row those of all files in the order of their paths.
    A file is read by the given encoding, or the one that its first bytes name, or as UTF-8, or where that can't be, as ISO-8859-1.
    """
    aliases = {kind: (*LIST_ALIASES[kind], *MORE_ALIASES[kind]) for kind in LIST_ALIASES}
    rows = read_files(spark, path, aliases["company_name"], aliases["cin"], company_name_column, cin_column, encoding)
    sizes = rows.groupBy(F.col("file").alias("__file")).agg((F.max("file_row") + 1).alias("__rows"))  # one row for each file
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__file", F.coalesce(F.sum("__rows").over(earlier), F.lit(0).cast("long")).alias("__before"))
    text = F.when(~F.trim("company_name").isin(*NULL_TOKENS), F.col("company_name"))
    rows = rows.join(before, F.col("file") == F.col("__file")).select(
        normalize_text(text).alias("company_name"), normalize_cin(F.col("cin")).alias("cin"), (F.col("__before") + F.col("file_row")).alias("source_row"), "file", "file_row",
    )
    rows = rows.filter("company_name <> ''")
    return rows if places else rows.drop("file", "file_row")


def typed_company_years(df: DataFrame) -> DataFrame:
    """Text columns as a company-year table: missing tokens null, numbers coerced, absent columns null."""
    def text(c: str):
        if c not in df.columns:
            return F.lit(None).cast("string")
        return F.when(~F.trim(F.col(c).cast("string")).isin(*NULL_TOKENS), F.col(c).cast("string"))

    kinds = {c: number(text(c)) for c in NUMERIC} | {"financial_year": number(text("financial_year")).cast("int")}
    return df.select(*[kinds.get(c, text(c)).alias(c) for c in COLUMNS])


def read_company_years(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of company-years, read as text and typed with bad numbers as null."""
    return typed_company_years(spark.read.option("header", True).csv(path))


def read_json_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON payloads, each an object, a list of objects, or an object with a list `rows`, as rows of a schema."""
    return _payload_rows(spark.read.option("wholetext", True).text(path), schema.simpleString())


def read_json_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The same payloads, one a line, so that large files are split; fields as in DDL."""
    return _payload_rows(spark.read.text(path), StructType.fromDDL(fields).simpleString())


def _payload_rows(texts: DataFrame, row: str) -> DataFrame:
    body = texts.select(F.trim("value").alias("v"))
    wrapped = F.from_json("v", f"struct<rows:array<{row}>>")["rows"]
    listed = F.from_json("v", f"array<{row}>")
    rows = body.select(F.explode(F.when(wrapped.isNotNull(), wrapped).otherwise(listed)).alias("r"))
    return rows.select("r.*")


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table, or an empty one where nothing has been written."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = "financial_year", order: list[str] | None = None, rows_per_file: int = 1_000_000) -> None:
    """Write a result, empty ones with their schema too.

    With an order, files hold consecutive ranges of it, sorted within, so that their least and largest values are close
    and don't overlap. Ranges are sampled; rows that tie in the order are salted, so that a value that very many rows
    share fills several files, and only such a value stands in two.
    """
    if order:
        files = -(-df.count() // rows_per_file) or 1
        by = [F.col(c).asc_nulls_first() for c in order]
        df = df.withColumn("__salt", F.rand(3)).repartitionByRange(files, *by, F.col("__salt")).sortWithinPartitions(*by).drop("__salt")
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif partition and partition in df.columns and not order:
        writer.partitionBy(partition).parquet(path)
    else:
        writer.parquet(path)


def append_with_checkpoint(df: DataFrame, done: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("cin", "financial_year")) -> None:
    """Append the rows whose keys aren't done, then mark their keys; what is marked is read from the output itself.

    A key that the output holds is not appended again, so a job that ended between the two writes, or within the first, can be
    started again. Of several rows of a key the least by its other columns counts, whatever their order.
    """
    spark, k = df.sparkSession, list(keys)
    have = existing(spark, out, df.schema)
    new = without(first_by_all(df, k), [done, have], k)
    new.write.mode("append").parquet(out)
    marked = existing(spark, checkpoint, df.select(*k).schema)
    fresh = without(spark.read.schema(df.schema).parquet(out).select(*k).distinct(), [done, marked], k)
    fresh.write.mode("append").parquet(checkpoint)
