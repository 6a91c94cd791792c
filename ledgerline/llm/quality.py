"""Quality rules: counts within each text, and lines that too many documents of a host share.

All of it is built-in functions. Lines are normalised and hashed; per host the distinct documents with a line
are counted over the whole table, equal texts as one document, so that copies, which other operators remove,
don't make a text's own lines look like boilerplate. Lines above the host's limit are removed from every
document of the host, and a document that loses too much of itself is rejected.

A null text has no words and no lines. A null source is a host of its own. Rows that are equal in source and
text get the same verdict, whatever their ids. An empty table gives an empty result. Columns of docs that
have names of the result's are not needed and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, own_prefix, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window that may repeat.
WINDOW = 5
#: A base rule: documents need so many words.
LEAST_WORDS = 10
#: A base rule: per cent of the words that may lie in repeated windows.
MOST_REPEATED = 20
#: A line is above the limit in more documents of its host than this ...
LEAST_DOCS = 10
#: ... and in more than this share of the host's documents.
DOC_SHARE = 0.1
#: A document is depleted when its lines above the limit hold more than this share of its words.
MOST_REMOVED = 0.5


def line_words(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(line, WORD, "x"), GAP, ""))


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case, digits as 0, runs of ASCII punctuation and spaces as one space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\p{Punct}\x20\x09-\x0D]+", " ")))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    The hashes of a text's windows are sorted with their places; equal neighbours are repeats. Their places, in
    order, each add the words that the repeat before them has not covered. Texts without repeats skip the sort.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    names = docs.columns
    rows = docs.withColumn("__words", F.filter(F.split(text_, GAP), lambda w: w != ""))
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    windows = F.transform(F.slice("__words", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[word(i + k) for k in range(1, WINDOW)]))
    rows = rows.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(text_) - F.length(F.regexp_replace(text_, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text_, "\n"), lambda x: x.rlike(WORD)).alias("__lines"),
        windows.alias("__windows"),
    )
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(
        *names, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, placed).alias("__placed"),
    )
    at = lambda k: F.get("__placed", k)["h"]
    places = F.transform(
        F.filter(
            F.transform("__placed", lambda s, k: F.struct(s["i"].alias("i"), (F.coalesce(at(k - 1) == s["h"], F.lit(False)) | F.coalesce(at(k + 1) == s["h"], F.lit(False))).alias("again"))),
            lambda s: s["again"],
        ),
        lambda s: s["i"],
    )
    covered = F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def assessed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", least_docs: int = LEAST_DOCS, doc_share: float = DOC_SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """Per row of docs: doc_id, host, text_hash, the counts, base_failed, kept, and `removed`: hashes of its lines above the limit.

    The counts and each line's hash and words are computed once and written, without the texts. What follows
    joins on (host, hash), whose sides are all written before, so that a large group of copies is a skewed join
    that Spark splits.
    """
    text_ = F.col(text)
    lines = F.transform(F.filter(text_lines(text_), lambda x: x.rlike(WORD)), lambda x: F.struct(line_hash(x).alias("line"), line_words(x).alias("words")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("host"), text_.alias("text"))
    rows = with_counts(rows.select("doc_id", "host", "text", F.xxhash64(F.coalesce(text_, F.lit(""))).alias("text_hash"), lines.alias("lines")))
    rows = written(rows.drop("text"), "quality-counts")
    copies = rows.groupBy("host", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    lines_of = rows.select("host", "text_hash", F.explode("lines").alias("x")).groupBy("host", "x.line", "text_hash").agg(F.sum("x.words").alias("words"))
    lines_of = written(lines_of, "quality-lines", "snappy")
    shared = lines_of.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > least_docs)
    hosts = written(copies.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "of"), "hosts", "snappy")
    above = shared.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n_docs") > doc_share * F.col("host_docs"))
    above = written(above.select(F.col("host").alias("above_host"), F.col("line").alias("above_line")), "lines-above", "snappy")
    hit = lines_of.join(above, F.col("host").eqNullSafe(F.col("above_host")) & (F.col("line") == F.col("above_line")))
    hit = hit.groupBy("host", "text_hash").agg(F.sum("words").alias("words"), F.collect_set("line").alias("removed"))
    hit = hit.join(copies.withColumnsRenamed({"host": "h", "text_hash": "t"}), F.col("host").eqNullSafe(F.col("h")) & (F.col("text_hash") == F.col("t")))
    hit = written(hit.select(F.col("host").alias("hit_host"), F.col("text_hash").alias("hit_hash"), "removed", (F.col("words") / F.col("copies")).alias("removed_words")), "lines-hit")
    out = rows.drop("lines").join(hit, F.col("host").eqNullSafe(F.col("hit_host")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.coalesce(F.col("removed_words"), F.lit(0.0)) > most_removed * F.col("n_words")
    return out.drop("hit_host", "hit_hash").withColumns({"base_failed": failed, "removed_words": F.coalesce(F.col("removed_words"), F.lit(0.0)).cast("long")}).withColumn("kept", ~F.col("base_failed") & ~depleted)


def cleaned(docs: DataFrame, text: str = "text", source: str = "source", **limits) -> DataFrame:
    """The rows of docs that are kept, all their columns, their lines above the limit removed from the text."""
    own = own_prefix(docs)
    verdicts = assessed(docs, text=text, source=source, **limits)
    verdicts = verdicts.groupBy("host", "text_hash").agg(F.any_value("kept").alias(f"{own}kept"), F.any_value("removed").alias(f"{own}removed"))
    verdicts = written(verdicts.withColumnsRenamed({"host": f"{own}host", "text_hash": f"{own}of"}), "verdicts")
    rows = docs.withColumn(f"{own}hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(verdicts, F.col(source).eqNullSafe(F.col(f"{own}host")) & (F.col(f"{own}hash") == F.col(f"{own}of"))).filter(F.col(f"{own}kept"))
    removed = F.col(f"{own}removed")
    left = F.array_join(F.filter(text_lines(F.col(text)), lambda x: ~(x.rlike(WORD) & F.array_contains(removed, line_hash(x)))), "\n")
    return rows.withColumn(text, F.when(removed.isNull(), F.col(text)).otherwise(left)).select(*docs.columns)
