"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, flatgraph, licenses, lines, merkle, mixing, quality, sharding, simhash, spotsigs, suffix, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, equal payloads as revisits, read back from the archives."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, and whether it stays by them and by the lines that its host's documents share."""
    rows = quality.assessed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2], w[p + 3], w[p + 4]) AS n FROM i),
c AS (SELECT r, least(5, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -5)) AS more FROM g WHERE n > 1),
rep AS (SELECT r, sum(more)::BIGINT AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (
  SELECT r, source, text, line,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[[:punct:]\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
above AS (
  SELECT lw.source, norm FROM lw JOIN hosts h ON lw.source IS NOT DISTINCT FROM h.source
  GROUP BY lw.source, norm, host_docs HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > 0.1 * host_docs),
hit AS (
  SELECT r, sum(words) AS removed FROM lw JOIN above a ON lw.source IS NOT DISTINCT FROM a.source AND lw.norm = a.norm GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN hit USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND removed_words <= 0.5 * n_words AS kept, removed_words
FROM m
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids by the public byte-level vocabulary, and what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.decode_texts(bpe.encode_texts(docs, path, pattern).drop("text"), path, pattern)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT] AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * source_size / weight AS ratio,
         row_number() OVER w AS place,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST)),
l AS (SELECT arg_min(level, place) AS level FROM f WHERE ratio > level),
t AS (
  SELECT source, source_size,
         CASE WHEN l.level IS NULL OR ratio <= l.level THEN (2 * source_size)::DOUBLE ELSE l.level * weight END AS target
  FROM f, l),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, the license that it is, and those that its lines name."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {licenses.whole_sql("text")} AS form FROM documents),
known AS (
  SELECT digest, min(id) AS license_id
  FROM (SELECT sha256({licenses.whole_sql("t")}) AS digest, id FROM (VALUES {licenses.values_sql(licenses.TEXTS)}) v(id, t)
        UNION ALL SELECT * FROM (VALUES {licenses.values_sql(licenses.DIGESTS.items())}) w) GROUP BY 1),
notes AS (SELECT {licenses.line_sql("t")} AS form, min(id) AS notice_id FROM (VALUES {licenses.values_sql(licenses.NOTICES)}) v(id, t) GROUP BY 1),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (
  SELECT r, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notice_ids, count(*) AS n_notices
  FROM l JOIN notes ON {licenses.line_sql("line")} = notes.form GROUP BY r)
SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS canonical_digest, license_id,
       coalesce(notice_ids, '') AS notice_ids, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM d LEFT JOIN known ON form <> '' AND sha256(form) = known.digest LEFT JOIN n USING (r)
"""


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 by rendezvous hashing of its id."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the strings of 400 bytes that start elsewhere, too."""
    return suffix.repeat_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three words and the smallest id that it links to."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return spotsigs.edited_report(table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines that are like an earlier one of the corpus, by their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    rows = lines.with_removed(docs, every=True, whole=True)
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still folds to the root where a fifth of texts have changed."""
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def op12_flatgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's near duplicates by robust-pruned graphs on overlapping shards: their number, and the component's smallest id."""
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's place along the eight leading components, whitened, by Chebyshev-filtered subspace iteration."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def field_sql(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(field_sql(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


#: The CRC-32 of a short text: eight shifts for each byte, by the polynomial of zlib.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {leaf_sql("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {CRC_SQL} % 5 = 0 THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS found
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (
  SELECT 0 AS lvl, source, pos, leaf AS digest, n FROM l
  UNION ALL
  SELECT lvl + 1, source, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY lvl, source, pos // 16, n),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, subroot AS digest, n FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, pos // 16, n),
top AS (SELECT digest AS root FROM u WHERE n = 1),
runs AS (SELECT source, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS nodes FROM t WHERE n > 1 GROUP BY ALL),
tops AS (SELECT lvl, pos // 16 AS run, list(digest ORDER BY pos) AS nodes FROM u WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT r, lvl AS step, 1 + (pos // (16 ** lvl)::BIGINT) % 16 AS place, nodes FROM l JOIN runs ON l.source IS NOT DISTINCT FROM runs.source AND pos // (16 ** (lvl + 1))::BIGINT = run
  UNION ALL
  SELECT r, 100 + lvl, 1 + (s.pos // (16 ** lvl)::BIGINT) % 16, nodes FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN tops ON s.pos // (16 ** (lvl + 1))::BIGINT = run),
placed AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS k, array_to_string(nodes[1:place - 1], '') AS before, array_to_string(nodes[place + 1:], '') AS after FROM steps),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM placed GROUP BY r),
fold AS (
  SELECT r, 0 AS k, coalesce(found, leaf) AS digest FROM l
  UNION ALL
  SELECT fold.r, fold.k + 1, sha256(before || digest || after) FROM fold JOIN placed ON placed.r = fold.r AND placed.k = fold.k + 1),
folded AS (SELECT r, arg_max(digest, k) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN folded USING (r) LEFT JOIN proof USING (r), top
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_source_mixing": op4_source_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_rendezvous_shards": op6_rendezvous_shards,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_spotsigs": op9_spotsigs,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_merkle": op11_merkle,
    "op12_flatgraph": op12_flatgraph,
    "op13_whitening": op13_whitening,
}
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (
  SELECT *, list_transform(range(1, 40, 10), lambda k: ('0x' || substr(hex, k, 10))::BIGINT) AS parts FROM h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda n: array_to_string(list_transform(range(35, -1, -5), lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((n >> s) & 31), 1)), '')), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_source_mixing": OP4_SQL, "op5_license_scan": OP5_SQL, "op11_merkle": OP11_SQL}
