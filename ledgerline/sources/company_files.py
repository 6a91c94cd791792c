"""Company lists from many CSV files, each with its own header, encoding and order of columns.

A file is one row of Spark's binary reader, so that any store that Spark reads will do, and one Python task parses a
file at a time in the CSV dialect of spreadsheets, quoted line breaks included, and hands its rows on in batches. Spark
limits a file to 2 GB; larger exports come in parts anyway.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 10_000
SCHEMA = "file string, file_row long, company_name string, cin string"
#: Marks at the start of a file that name its encoding: fixed values.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def encoding_of(body: bytes, given: str | None = None) -> str:
    """The given encoding where it decodes the whole file, or the one that its first bytes name; else UTF-8, else ISO-8859-1."""
    named = next((name for mark, name in MARKS if body.startswith(mark)), None)
    for name in (given, named, "utf-8"):
        if name:
            try:
                body.decode(name)
                return name
            except (UnicodeDecodeError, LookupError):
                continue
    return "iso-8859-1"


def column_of(header: list[str], given: str | None, aliases: tuple[str, ...]) -> int | None:
    """Where a column stands in a header: by its given name, else the first header in the file's order that is an alias."""
    if given in header:
        return header.index(given)
    known = [" ".join(h.lower().split()) for h in header]
    return next((i for i, h in enumerate(known) if h in aliases), None)


def parsed(body: bytes, names: tuple[str, ...], cins: tuple[str, ...], name_column: str | None = None, cin_column: str | None = None, encoding: str | None = None) -> Iterator[tuple[int, str, str | None]]:
    """(row, name, cin) of a file, its rows numbered from 0 behind the header; blank lines are no rows. A file without a name column is an error."""
    lines = csv.reader(io.TextIOWrapper(io.BytesIO(body), encoding_of(body, encoding), errors="replace", newline=""))
    header = next((h for h in lines if h), None)
    if header is None:
        return
    name, cin = column_of(header, name_column, names), column_of(header, cin_column, cins)
    if name is None:
        raise ValueError(f"no company name column among {', '.join(header)}")
    cell = lambda row, i: row[i] if i is not None and i < len(row) else None
    for place, row in enumerate(r for r in lines if r):
        yield place, cell(row, name), cell(row, cin)


def read_files(spark: SparkSession, path: str, names: tuple[str, ...], cins: tuple[str, ...], name_column: str | None = None, cin_column: str | None = None, encoding: str | None = None) -> DataFrame:
    """(file, file_row, company_name, cin) of all CSV files of a path and its folders, as they are written there."""
    csv.field_size_limit(1 << 30)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for file, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                part: list[tuple] = []
                try:
                    for row in parsed(body.as_py() or b"", names, cins, name_column, cin_column, encoding):
                        part.append((file, *row))
                        if len(part) == BATCH:
                            yield _batch(part)
                            part = []
                except (ValueError, csv.Error) as e:
                    raise ValueError(f"{file}: {e}") from e
                if part:
                    yield _batch(part)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]")).select("path", "content").mapInArrow(rows, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "file_row", "company_name", "cin"])
