"""Exact removal of long repeated byte strings, through run-length suffix indexes.

Every string of `length` bytes that starts at two places of the corpus goes, at all of its places. No one task
can hold the corpus's index, so it is cut where no match is lost:

1. Each window of `length` bytes picks an anchor: its smallest hash of GRAM bytes, the leftmost of equals. Equal
   windows pick equal anchors at equal places. Neighbouring windows with one anchor make a segment, and each
   window of a document lies in one segment only.
2. A segment whose anchor occurs once in the corpus holds no repeat. Of the others, equal segments are one; what
   occurs twice or more is repeated whole.
3. Distinct segments with a common anchor go to one bucket, small anchors together. There a run-compressed
   Burrows-Wheeler transform is built. Lengths of matches with the suffixes before and after are sampled at the
   runs' ends, where they are found by comparison, and stream from there through the text: between samples each
   is its predecessor's less one. Windows whose match reaches `length` are marked.
4. An anchor with more than CROWD distinct segments would outgrow a task. Its windows are hashed to 128 bits
   instead, one by one, and counted; so nothing is left out at any size.

Hashes of 64 bits only bring candidates together, or name a segment with its anchor (128 bits in all); a text is
named by 128 bits and its size. A null text is the empty text. Rows with equal texts get equal results, a text that
occurs twice is removed whole if it has `length` bytes; texts of any length are cut into segments in pieces that
overlap by a window. Columns of docs named k or size are not carried along. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import discard, written

LENGTH = 400
#: Bytes of the hashed strings that anchors are chosen among.
GRAM = 32
#: Distinct segments of one anchor that share an index.
CROWD = 4000
#: Bytes of segments in a bucket.
BUCKET_BYTES = 1 << 20

SEGMENTS = "array<struct<at:int,n:int,anchor:bigint,digest:bigint>>"
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 28) - 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, n, anchor): first window, number of windows and anchor hash of each segment of a text."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none
    if len(text) > int(_PLACE):  # places must fit beside the hashes: cut, with windows that overlap the cut in one piece only
        step = 1 << 27
        parts = [(k, segments_of(text[k : k + step + length - 1], length, gram)) for k in range(0, len(text) - length + 1, step)]
        return tuple(np.concatenate([p[i] + (k if i == 0 else 0) for k, p in parts]) for i in range(3))
    h, width, factor = _BYTE[np.frombuffer(text, np.uint8)], 1, _FACTOR
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    chosen = (least & _PLACE).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    n = np.diff(np.append(at, len(chosen)))
    return at, n, h[chosen[at]].view(np.int64)


def segments(text: Column, length: int) -> Column:
    @F.arrow_udf(SEGMENTS)
    def cut(texts: pa.Array) -> pa.Array:
        offsets, ats, ns, anchors, digests = [0], [], [], [], []
        for x in texts:
            raw = x.as_buffer().to_pybytes()
            at, n, anchor = segments_of(raw, length)
            ats.append(at)
            ns.append(n)
            anchors.append(anchor)
            digests += [xxh3_64_intdigest(raw[s:e]) for s, e in zip(at.tolist(), (at + n + length - 1).tolist())]
            offsets.append(offsets[-1] + len(at))
        flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind))
        digest = pa.array(np.array(digests, np.uint64).view(np.int64))
        rows = pa.StructArray.from_arrays([flat(ats, np.int32), flat(ns, np.int32), flat(anchors, np.int64), digest], ["at", "n", "anchor", "digest"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return cut(text)


def suffix_order(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, place) of all suffixes, by prefix doubling; only what is still tied is sorted again."""
    n, width = len(symbols), 1
    key = symbols.astype(np.int64)
    while alphabet ** (2 * width) < 1 << 62 and width < n:
        shifted = np.zeros(n, np.int64)
        shifted[:-width] = key[width:]
        key = key * alphabet**width + shifted
        width *= 2
    place = np.empty(n + 1, np.int64)
    place[n] = -1
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        first, second = place[tied], place[np.minimum(tied + width, n)]
        by = np.argsort(first * (n + 1) + second + 1, kind="stable")
        tied, first, second = tied[by], first[by], second[by]
        group = np.concatenate(([True], first[1:] != first[:-1]))
        new = group | np.concatenate(([True], second[1:] != second[:-1]))
        steps = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(group, steps, 0))
        place[tied] = first + np.maximum.accumulate(np.where(new, steps, 0)) - start
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    place = place[:n]
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order, place


def common_lengths(raw: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b that end with their segments, `left` bytes on."""
    limit = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(16, np.uint8))), 8)
    going = np.flatnonzero(limit > 0)
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        same = (words[x] == words[y]).astype(np.uint8)
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        out[going] += run
        going = going[(run == 8) & (out[going] < limit[going])]
    return np.minimum(out, limit)


def match_lengths(contents: list[bytes]) -> np.ndarray:
    """For each byte of the contents joined with one separator after each, the longest match that starts elsewhere.

    Separators sort before all bytes and by their order, and match nothing.
    """
    count = len(contents)
    sizes = np.fromiter(map(len, contents), np.int64, count)
    ends = np.cumsum(sizes + 1) - 1
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + count
    symbols[ends] = np.arange(count)
    left = np.repeat(ends, sizes + 1) - np.arange(len(raw))
    order, _ = suffix_order(symbols, count + 256)
    before = symbols[order - 1]  # the transform; before the first byte stands the last separator
    ends_run = np.append(before[1:] != before[:-1], True)
    heads_run = np.concatenate(([True], ends_run[:-1]))
    best = np.zeros(len(raw), np.int64)
    for sampled, shift in ((heads_run, -1), (ends_run, 1)):
        rows = np.flatnonzero(sampled)
        known = np.full(len(raw), -1, np.int64)
        edge = 0 if shift < 0 else len(raw) - 1
        inner = rows[rows != edge]
        known[order[edge]] = 0
        known[order[inner]] = common_lengths(raw, left, order[inner], order[inner + shift])
        at = np.arange(len(raw))
        source = np.maximum.accumulate(np.where(known >= 0, at, 0))
        best = np.maximum(best, known[source] + source - at)
    return best


def ranges(flags: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs of set flags."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def indexed(bucket: pa.Table, length: int) -> pa.Table:
    """The marked windows of a bucket's segments."""
    contents = bucket["content"].to_pylist()
    anchors, digests, marks = [], [], []
    if len(contents):
        best, at = match_lengths(contents), 0
        for k, content in enumerate(contents):
            found = ranges(best[at : at + len(content)] >= length)
            at += len(content) + 1
            if found:
                anchors.append(bucket["anchor"][k].as_py())
                digests.append(bucket["digest"][k].as_py())
                marks.append(found)
    return pa.table({"anchor": pa.array(anchors, pa.int64()), "digest": pa.array(digests, pa.int64()), "marks": pa.array(marks, pa.list_(pa.int32()))})


def window_digests(content: Column, length: int) -> Column:
    @F.arrow_udf("array<binary>")
    def digest(contents: pa.Array) -> pa.Array:
        rows = []
        for x in contents:
            raw = x.as_buffer().to_pybytes()
            rows.append([xxh3_128_digest(raw[i : i + length]) for i in range(len(raw) - length + 1)])
        return pa.array(rows, pa.list_(pa.binary()))

    return digest(content)


def taken_out(text: Column, spans: Column) -> Column:
    """struct(kept, n_removed, n_spans) of a text without the bytes in `spans`: starts << 32 | ends, in any order."""

    @F.arrow_udf("struct<kept:binary,n_removed:bigint,n_spans:bigint>")
    def cut(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        rows = []
        for text, spans in zip(texts, all_spans):
            if not spans.is_valid:
                rows.append(None)
                continue
            raw, kept, done, runs, removed = text.as_buffer().to_pybytes(), [], 0, 0, 0
            last = -1
            for start, end in sorted((x >> 32, x & 0xFFFFFFFF) for x in spans.as_py()):
                runs += start > last
                last = max(last, end)
                if end > done:
                    kept.append(raw[done : max(done, start)])
                    removed += end - max(done, start)
                    done = end
            kept.append(raw[done:])
            rows.append({"kept": b"".join(kept), "n_removed": removed, "n_spans": runs})
        return pa.array(rows, pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]))

    return cut(text, spans)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, results): docs with their texts' keys k and size instead of the text, and per distinct text k, size, n_removed, n_spans, kept."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    others = [c for c in docs.columns if c not in (text, "k", "size")]
    rows = docs.select(*others, F.unhex(F.md5(raw)).alias("k"), F.length(raw).alias("size"))
    keyed = docs.select(F.unhex(F.md5(raw)).alias("k"), F.length(raw).alias("size"), raw.alias("raw"))
    texts = written(keyed.groupBy("k", "size").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies")), "texts")
    found = written(texts.filter(F.col("size") >= length).select("k", "size", "copies", F.explode(segments(F.col("raw"), length)).alias("x")).select("k", "size", "copies", "x.*"), "segments", "snappy")

    anchors = found.groupBy(F.col("anchor").alias("common")).agg(F.sum("copies").alias("times"), (F.min("digest") != F.max("digest")).alias("several")).filter("times > 1").drop("times")
    anchors = written(anchors, "anchors", "snappy")
    shared = written(found.join(anchors, F.col("anchor") == F.col("common")).drop("common"), "shared", "snappy")
    discard(found)
    distinct = shared.groupBy("anchor", "digest").agg(F.sum("copies").alias("times"), F.first("several").alias("several"), F.min(F.struct("k", "size", "at", "n")).alias("one"))
    distinct = written(distinct, "distinct", "snappy")
    whole = distinct.filter("times > 1").select("anchor", "digest", F.array(F.lit(0), F.col("one.n")).alias("marks"))

    compared = distinct.filter("several")
    crowded = compared.groupBy(F.col("anchor").alias("common")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("common")
    crowded = written(crowded, "crowded", "snappy")
    fetched = compared.select(F.col("one.k").alias("of"), F.col("one.size").alias("of_size"), F.struct("anchor", "digest", F.col("one.at").alias("at"), F.col("one.n").alias("n")).alias("x"))
    fetched = fetched.groupBy("of", "of_size").agg(F.collect_list("x").alias("xs"))
    contents = texts.join(fetched, (F.col("k") == F.col("of")) & (F.col("size") == F.col("of_size"))).select("raw", F.explode("xs").alias("x"))
    contents = contents.select("x.anchor", "x.digest", F.col("raw").substr(F.col("x.at") + 1, F.col("x.n") + (length - 1)).alias("content"))
    contents = written(contents, "contents")
    total = contents.agg(F.sum(F.length("content"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    crowds = contents.join(crowded, F.col("anchor") == F.col("common"), "left_semi")
    usual = contents.join(crowded, F.col("anchor") == F.col("common"), "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    marked = usual.groupBy("bucket").applyInArrow(lambda t: indexed(t, length), "anchor bigint, digest bigint, marks array<int>")
    windows = crowds.select("anchor", "digest", F.posexplode(window_digests(F.col("content"), length)).alias("i", "w"))
    twice = written(windows.groupBy(F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v"), "windows", "snappy")
    single = windows.join(twice, F.col("w") == F.col("v")).select("anchor", "digest", F.array("i", F.col("i") + 1).alias("marks"))
    marks = written(whole.union(marked).union(single).withColumnsRenamed({"anchor": "mark_anchor", "digest": "mark_digest"}), "marks", "snappy")
    for old in (contents, distinct):
        discard(old)

    hit = shared.join(marks, (F.col("anchor") == F.col("mark_anchor")) & (F.col("digest") == F.col("mark_digest")))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.size("marks") - 2, F.lit(2)), lambda i: F.shiftleft((F.col("at") + F.get("marks", i)).cast("long"), 32).bitwiseOR((F.col("at") + F.get("marks", i + 1) + (length - 1)).cast("long"))))
    spans = hit.select(F.col("k").alias("of"), F.col("size").alias("of_size"), pair.alias("span")).groupBy("of", "of_size").agg(F.collect_set("span").alias("spans"))
    spans = written(spans, "spans", "snappy")
    cut = texts.join(spans, (F.col("k") == F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    cut = cut.select("k", "size", "raw", taken_out(F.when(F.col("spans").isNotNull(), F.col("raw")), F.col("spans")).alias("cut"))
    results = cut.select("k", "size", F.coalesce("cut.n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut.n_spans", F.lit(0)).alias("n_spans"), F.coalesce("cut.kept", "raw").alias("kept"))
    return rows, results


def repeat_report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **sizes) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, the SHA-256 of the bytes that stay, their number, and they themselves as text.

    Where a removed run begins or ends within a character, what is left of it stands in kept_text as U+FFFD.
    """
    rows, results = without_repeats(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", length, **sizes)
    results = results.select(F.col("k").alias("of"), F.col("size").alias("of_size"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("kept_bytes"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
    results = written(results, "repeats")
    out = rows.join(results, (F.col("k") == F.col("of")) & (F.col("size") == F.col("of_size")))
    return out.select("doc_id", F.col("size").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept_bytes", "kept_text")
