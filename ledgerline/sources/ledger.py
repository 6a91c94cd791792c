"""A table in buckets of a key, written in batches that are there as a whole or not at all.

Layout: data/batch=<id>/bucket=<b>/ and, for each finished batch, an empty file commits/<id>. The commit is one
creation of a file that must not exist, which stores do atomically: a batch whose job died has data but no commit, is not
read, and is written over when it comes again; a batch that comes again after its commit is passed over. A reader that
wants some keys reads the folders of their buckets only. `compact` puts all batches so far into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Ledger:
    """Batches of rows under a path, by buckets of a key."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType([f for f in schema.fields if f.name not in ("batch", "bucket")])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _at(self, *parts: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def batches(self) -> list[str]:
        """Names of what is committed: the last compaction, named c<id>, and the batches behind it."""
        at, files = self._at("commits")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        compact = max((int(n[1:]) for n in names if n.startswith("c")), default=None)
        rest = sorted(int(n) for n in names if not n.startswith("c"))
        return ([f"c{compact}"] if compact is not None else []) + [str(n) for n in rest if compact is None or n > compact]

    def committed(self, batch: int) -> bool:
        names = self.batches()
        return str(batch) in names or any(n.startswith("c") and int(n[1:]) >= batch for n in names)

    def read(self, buckets: list[int] | None = None, before: int | None = None, only: int | None = None) -> DataFrame:
        """Rows of committed batches with batch and bucket: of some buckets, of batches before one, or of one."""
        names = [n for n in self.batches() if (before is None or int(n.lstrip("c")) < before) and (only is None or n == str(only))]
        schema = StructType([*self.schema.fields]).add("batch", "string").add("bucket", "integer")
        if not names:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*[f"{self.path}/data/batch={n}" for n in names])
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows fall in: a list of at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.select(*self.schema.names, self.bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={name}")

    def _commit(self, name: str) -> None:
        at, files = self._at("commits", name)
        files.mkdirs(at.getParent())
        files.create(at, False).close()

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch and commit it; nothing, and False, if it is committed already."""
        if self.committed(batch):
            return False
        # rows of one bucket go to few files: each task would else write one for every bucket
        self._write(rows.repartition(self.bucket()), str(batch))
        self._commit(str(batch))
        return True

    def compact(self) -> None:
        """All committed batches as one; the old ones stay until they are removed by hand, as readers may be at them."""
        if len(names := self.batches()) > 1:
            name = f"c{max(int(n.lstrip('c')) for n in names)}"
            self._write(self.read().repartition(self.bucket()), name)
            self._commit(name)


def first_by_all(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the least by its other columns, whatever the order of the rows."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row"))
    return best.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def without(df: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose keys are in none of some tables."""
    return reduce(lambda rows, t: rows.join(t.select(*keys), keys, "left_anti"), tables, df)
