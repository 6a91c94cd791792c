"""WARC archives as a PySpark data source, with record-type and header predicates pushed down.

Reading plans one task for each archive, small archives together. A task streams through its records: the
headers of each are parsed first, the pushed predicates are put to them, and the payload of a record that
fails, or of which the payload isn't asked for, is passed over without being decoded or kept.

Writing makes one or more archives per task, a gzip member per record, under temporary names; the commit
renames those of the tasks that succeeded. Both sides go through a file system chosen by the path's scheme.

Null payloads are empty, null header values are left out, line breaks in them are escaped. A page id may be
null or repeated; a repeated id with an equal payload is a response each time. An empty table makes no record.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: The header that each column holds.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A task's archive is closed, and a new one begun, beyond so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Small archives are read by one task up to so many bytes.
TASK_BYTES = 64 << 20
#: Rows are handed to Spark in batches of about so many bytes of payload.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Archives(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(None)
        self.paths = tuple(paths)


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(schema, self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names = schema.fieldNames()
        self.path = path
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take the predicates on header columns; hand back the others."""
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "there", StringStartsWith: "starts", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            kind, column = kinds.get(type(f)), ".".join(getattr(f, "attribute", ()))
            if kind and column in HEADERS and column != "payload_length":
                self.tests.append((kind, HEADERS[column], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, at = file_system(self.path)
        files = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))] if fs.get_file_info(at).type == pafs.FileType.Directory else [fs.get_file_info(at)]
        tasks, held = [[]], 0
        for x in sorted(files, key=lambda x: x.path):
            if tasks[-1] and held + x.size > TASK_BYTES:
                tasks.append([])
                held = 0
            tasks[-1].append(x.path)
            held += x.size
        return [Archives(x) for x in tasks if x]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            found = headers.get(name)
            if found is None:
                return False
            if not {
                "eq": lambda: found == value, "in": lambda: found in value, "there": lambda: True, "starts": lambda: found.startswith(value),
                "gt": lambda: found > value, "ge": lambda: found >= value, "lt": lambda: found < value, "le": lambda: found <= value,
            }[kind]():
                return False
        return True

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        fields = [pa.field(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_length" else pa.string()) for n in self.names]
        rows: list[list] = [[] for _ in self.names]
        held = 0
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
                for headers, body in records(stream):
                    if not self.wanted(headers):
                        continue
                    for name, column in zip(self.names, rows):
                        if name == "payload":
                            column.append(payload := body())
                            held += len(payload or b"")
                        elif name == "payload_length":
                            column.append(int(headers[HEADERS[name]]) if HEADERS[name] in headers else None)
                        else:
                            column.append(headers.get(HEADERS[name]))
                    held += 200
                    if held > BATCH_BYTES or held > 200 * BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, fields)], schema=pa.schema(fields))
                        rows, held = [[] for _ in self.names], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, fields)], schema=pa.schema(fields))


def records(stream: io.BufferedReader):
    """(headers, body) of each record; body() reads the payload, and what isn't read is passed over."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        left = [length]

        def body() -> bytes:
            block, left[0] = stream.read(left[0]), 0
            if len(block) < length:
                raise ValueError("an archive ends within a record")
            if headers.get("content-type", "").startswith("application/http"):
                head = block.find(b"\r\n\r\n")
                return block[head + 4 :] if head >= 0 else b""
            return block

        yield headers, body
        while left[0]:
            passed = stream.read(min(left[0], 1 << 20))
            if not passed:
                raise ValueError("an archive ends within a record")
            left[0] -= len(passed)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str):
        self.names = schema.fieldNames()
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, at = file_system(self.path)
        fs.create_dir(f"{at}/_pending", recursive=True)
        paths: list[str] = []
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.tell() > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    paths.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{at}/_pending/{paths[-1]}", compression=None)
                out.write(packed(record(row)))
        if out is not None:
            out.close()
        return Written(tuple(paths))

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        for task, message in enumerate(messages):
            for k, name in enumerate(message.paths if message else ()):
                fs.move(f"{at}/_pending/{name}", f"{at}/part-{task:05d}-{k:03d}.warc.gz")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}/_pending").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/_pending")


def packed(data: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def record(row: dict) -> bytes:
    """One record: a response holds its payload behind HTTP headers, a revisit no payload, others the payload alone."""
    kind = row["record_type"]
    payload = row.get("payload") or b""
    block = HTTP_HEAD + payload if kind == "response" else HTTP_HEAD if kind == "revisit" else payload
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": row.get("date"),
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Refers-To": row.get("refers_to"),
        "WARC-Profile": REVISIT_PROFILE if kind == "revisit" else None,
        "WARC-Payload-Digest": row.get("payload_digest"),
        "X-Payload-Length": row.get("payload_length"),
        "Content-Type": "application/http; msgtype=response" if kind in ("response", "revisit") else "application/octet-stream",
        "Content-Length": len(block),
    }
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: each 40 bits of it are eight digits."""
    hexed = F.sha1(data)
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]), digits, letters)


def with_revisits(records: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """records with payload_digest, payload_length, record_type and refers_to.

    Of the records with equal payloads of at least least_bytes, those with the largest key are responses and the
    others revisits of that key. Only the digests of payloads that occur twice are kept for the join.
    """
    names = records.columns
    rows = records.withColumns({"payload_digest": base32_sha1(F.col(payload)), "payload_length": F.length(payload).cast("long")})
    twice = rows.filter(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.max(key).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    twice = written(twice.select(F.col("payload_digest").alias("__digest"), "__first"), "payloads-twice", "snappy")
    rows = rows.join(twice, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_length") >= least_bytes), "left")
    revisit = F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first"))
    return rows.select(*names, "payload_digest", "payload_length", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"))


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of the archives at a path; filters on header columns are put to the headers by the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records, in columns of SCHEMA, as archives in a new folder."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record per page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = with_revisits(rows, "page_id", "payload", least_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    write_warc(
        rows.select(
            name(F.col("page_id")).alias("record_id"),
            "record_type",
            F.col("url").alias("target_uri"),
            F.lit("2024-01-01T00:00:00Z").alias("date"),
            F.when(F.col("refers_to").isNotNull(), name(F.col("refers_to"))).alias("refers_to"),
            F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
            "payload_length",
            F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
        ),
        path,
    )
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as long)")
    full = read_warc(spark, path, ["record_id", "record_type", "target_uri", "payload"]).filter("record_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), F.col("target_uri").alias("url"))
    again = read_warc(spark, path, ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length"]).filter("record_type = 'revisit'")
    again = again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
    return full.unionByName(again)
