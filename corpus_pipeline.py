"""A corpus pipeline: five stages of the text operators over `documents`, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, lines, mixing, quality, simhash
from ledgerline.llm.common import written

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def whole(docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of documents; n_chars counted again where the stage changes texts."""
    rows = docs.select(*COLUMNS)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if changed else rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and keep most of themselves, without lines that many of their host's documents share."""
    return whole(quality.cleaned(whole(docs)), changed=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, of lines that are alike only the first in the corpus."""
    return whole(lines.deduplicated(whole(docs), every=True), changed=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the first by id.

    SimHash over three words, linked at 4 of 64 differing bits or fewer, brings texts together, and so do bands of minima
    over five words, as 64 bits find few of the pairs at this similarity. Texts are linked if the Jaccard similarity of
    their five-word shingles is 0.8 or more, and what links join is a group.
    """
    return whole(simhash.one_of_each(whole(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; where it takes a part, its first words."""
    docs = whole(docs)
    return whole(mixing.mixed_rows(mixing.mix(docs), COLUMNS), changed=True)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document by the public vocabulary, and whether they decode to the text."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = bpe.decode_texts(bpe.encode_texts(rows, path, pattern), path, pattern)
    return rows.select(
        "doc_id",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: SimHash's XXH64, MinHash and token ids are not in the SQL of the check; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
