"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `most` differing bits or fewer. The bits are put in parts, correlated bits
together, and each part gets a threshold of its own: thresholds that add up to most - parts + 1 miss no link,
and -1 leaves a part out. Dynamic programming picks the thresholds that are least work by estimated candidates,
which are counted over all fingerprints. Each fingerprint is then looked up, in every part that is left, at up
to the part's threshold of flipped bits, and every candidate is verified on all 64 bits.

Where a value of a part is shared by more than BUCKET_MOST distinct fingerprints, those and all that probe
for it are linked through points instead: two fingerprints differ in 2 r bits or fewer if and only if some point
is within r bits of both. A point has a fixed number of fingerprints around it at most (65 for r = 1, 2081 for
r = 2), so no group's pairs are ever listed.

Equal fingerprints are one from the start. A null text has no words and the fingerprint zero, like any text
without words. Null ids are in components but never name one. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from .common import GAP, discard, own_prefix, text_key, written
from .components import connected_components

BITS = 64
#: Words in a shingle.
SHINGLE = 3
#: The seed of the shingles' XXH64.
SEED = 42
#: Fingerprints with one value of a part that are compared with each other directly.
BUCKET_MOST = 64
#: Numbers of parts that are tried.
PARTS = (2, 3, 4)
#: Minima of a text's sketch, sixteen bands of BAND: at a similarity of 0.8 one pair of a hundred shares none.
MINIMA = 96
BAND = 6
#: Texts of a bucket that are compared with so many others in one place.
BLOCK = 256
#: The orders of the minima: hashes times an odd factor plus a summand, from the golden ratio's powers in 64 bits.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(MINIMA)], np.uint64)
SUMMANDS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 2, 2**64) for i in range(MINIMA)], np.uint64)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text's words, A to Z lower-cased, split at ASCII white space; of fewer words, of all of them."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.array([xxh64_intdigest(joined[s:e], seed) for s, e in spans], np.uint64)


def fingerprint_bytes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text, as an unsigned number; zero without words."""
    if not text.split():
        return 0
    hashes = shingle_hashes(text, shingle, seed)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        block = hashes[i : i + 65536]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """A text's SimHash as a signed 64-bit number."""

    @F.arrow_udf(LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        found = (fingerprint_bytes(x.as_buffer().to_pybytes(), shingle, seed) if x.is_valid else 0 for x in texts)
        return pa.array(np.fromiter(found, np.uint64).view(np.int64), pa.int64())

    return simhash(text)


def bit_counts(prints: DataFrame) -> np.ndarray:
    """For each two bits, the number of fingerprints that have both: sums of 64 x 64 counts, one row from each task."""

    def counts(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(bits), 65536):
                total += bits[i : i + 65536].T @ bits[i : i + 65536]
        yield pd.DataFrame({"both": [total.ravel().tolist()]})

    rows = prints.select("fp").mapInPandas(counts, "both array<double>")
    cells = rows.select(F.posexplode("both")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for pos, n in cells:
        out[pos] = n
    return out.reshape(BITS, BITS)


def correlated_parts(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """The bits in `parts` even parts; each takes the bit with the most correlation left, then those most correlated with it."""
    p = np.diag(both) / total
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    near = np.abs(np.divide(both / total - np.outer(p, p), spread, out=np.zeros_like(both), where=spread > 0))
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        n = len(left) // (parts - k)
        part = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < n:
            part.append(max(left, key=lambda b: (near[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def part_value(fp: Column, part: list[int]) -> Column:
    mask = sum(1 << b for b in part)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask))


def estimated_work(prints: DataFrame, parts: list[list[int]], p: np.ndarray, total: int, most: int) -> list[dict[int, float]]:
    """For each part and threshold, the probes plus the candidates to verify.

    Pairs that agree in a part are counted over all fingerprints; those that differ in some of its bits are
    estimated from them by how often each bit differs.
    """
    values = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), part_value(F.col("fp"), x).alias("value")) for i, x in enumerate(parts)])).alias("x"))
    counts = values.groupBy("x.part", "x.value").agg(F.count(F.lit(1)).alias("n"))
    same = {r["part"]: float(r["pairs"] or 0) for r in counts.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    out = []
    for i, part in enumerate(parts):
        q = np.clip(2 * p[part] * (1 - p[part]), 0, 0.5)
        exactly = np.zeros(most + 1)  # odds that just so many bits of the part differ, against none
        exactly[0] = 1
        for odds in q / (1 - q):
            exactly[1:] += odds * exactly[:-1]
        pairs = max(same.get(i, 0.0), total * total / 2 * float(np.prod(1 - q)))
        grown = {-1: 0.0} | {t: pairs * exactly[: t + 1].sum() for t in range(most + 1)}
        out.append({t: grown[t] + total * sum(comb(len(part), k) for k in range(t + 1)) for t in range(-1, most + 1)})
    return out


def allocated(work: list[dict[int, float]], most: int) -> tuple[float, list[int]]:
    """The thresholds with the least work, by dynamic programming over parts and the sum of thresholds so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in work:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for (s, (w, chosen)), (t, more) in itertools.product(best.items(), part.items()):
            if s + t not in nxt or w + more < nxt[s + t][0]:
                nxt[s + t] = (w + more, [*chosen, t])
        best = nxt
    return best[most - len(work) + 1]


def flipped(prints: DataFrame, number: int, part: list[int], most: int) -> DataFrame:
    """(asks, p, v): the part's value of every fingerprint, with up to `most` of its bits flipped.

    Bits are picked one after another, each by its place above the last one's, so that a plan has one list of the
    part's bits for each step, however many values there are.
    """
    bits = F.array(*[part_value(F.lit(-1).cast("long"), [b]) for b in part])
    rows = prints.select(F.col("fp").alias("asks"), part_value(F.col("fp"), part).alias("v"), F.lit(0).alias("i"))
    for _ in range(most):  # place 0 flips none, and nothing follows it
        places = F.when(F.col("i") < 0, F.array(F.lit(-1))).otherwise(F.concat(F.array(F.lit(-1)), F.when(F.col("i") < len(part), F.sequence(F.col("i") + 1, F.lit(len(part)))).otherwise(F.array().cast("array<int>"))))
        rows = rows.withColumn("i", F.explode(places)).withColumn("v", F.when(F.col("i") > 0, F.col("v").bitwiseXOR(F.element_at(bits, F.greatest("i", F.lit(1))))).otherwise(F.col("v")))
    return rows.select("asks", F.lit(number).alias("p"), "v")


def near_links(prints: DataFrame, most: int = 2, bucket_most: int = BUCKET_MOST) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` of prints that differ in `most` bits or fewer, and no others."""
    if most not in (2, 4):
        raise ValueError("links through points are made for 2 or 4 differing bits")
    total = prints.count()
    if total < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    both = bit_counts(prints)
    p = np.diag(both) / max(total, 1)
    plans = []
    for n in PARTS:
        if n <= most + 1:
            parts = correlated_parts(both, max(total, 1), n)
            plans.append((*allocated(estimated_work(prints, parts, p, total, most), most), parts))
    _, thresholds, parts = min(plans, key=lambda x: x[0])
    used = [(i, part, t) for i, (part, t) in enumerate(zip(parts, thresholds)) if t >= 0]
    entry = lambda i, value: F.struct(F.lit(i).alias("part"), value.alias("value"))
    fp = F.col("fp")
    index = prints.select("fp", F.explode(F.array(*[entry(i, part_value(fp, part)) for i, part, _ in used])).alias("at")).select("fp", "at.part", "at.value")
    probes = reduce(DataFrame.union, [flipped(prints, i, part, t) for i, part, t in used])
    sizes = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.filter(F.col("n") > bucket_most).select(F.col("part").alias("lp"), F.col("value").alias("lv")), "large-parts", "snappy")
    in_large = lambda a, b: (F.col(a) == F.col("lp")) & (F.col(b) == F.col("lv"))
    small = index.join(large, in_large("part", "value"), "left_anti")
    direct = small.join(probes, (F.col("part") == F.col("p")) & (F.col("value") == F.col("v")) & (fp < F.col("asks")) & (F.bit_count(fp.bitwiseXOR(F.col("asks"))) <= most))
    direct = direct.select(fp.alias("a"), F.col("asks").alias("b"))
    crowded = probes.join(large, in_large("p", "v"), "left_semi").select(F.col("asks").alias("fp")).distinct()
    bit = lambda c: F.when(F.col(c) >= 0, F.expr(f"shiftleft(1L, {c})")).otherwise(F.lit(0).cast("long"))
    points = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i"))
    points = points.select("fp", "i", fp.bitwiseXOR(bit("i")).alias("point"))
    if most == 4:  # a second bit, above the first; a place of -1 flips none
        points = points.withColumn("j", F.explode(F.when(F.col("i") == BITS - 1, F.array(F.lit(-1))).otherwise(F.concat(F.array(F.lit(-1)), F.sequence(F.col("i") + 1, F.lit(BITS - 1))))))
        points = points.filter((F.col("i") >= 0) | (F.col("j") < 0)).select("fp", F.col("point").bitwiseXOR(bit("j")).alias("point"))
    around = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    through = around.select("a", F.explode("all").alias("b")).filter(F.col("a") < F.col("b"))
    return direct.union(through).distinct()


def components_of(rows: DataFrame, most: int) -> DataFrame:
    """(print, root, first): for each distinct fp of rows (doc_id, fp) its component's smallest fp, and its own smallest id."""
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints", "snappy")
    roots = connected_components(near_links(prints, most))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("print"), F.coalesce("root", "fp").alias("root"), "first")
    return written(rooted, "rooted", "snappy")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint, and the smallest id that links reach from it."""
    rows = written(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints", "snappy")
    rooted = components_of(rows, most)
    names = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of"), "names", "snappy")
    named = written(rooted.join(names, F.col("root") == F.col("of")).select("print", "component_id"), "named", "snappy")
    discard(rooted)
    return rows.join(named, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


def with_word_shingles(texts: DataFrame, text: str, n: int, out: str) -> DataFrame:
    """texts with the hashes of each text's distinct shingles of n words in place of the text; of fewer words, the one of all."""
    names = [c for c in texts.columns if c != text]
    rows = texts.withColumn("__words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP), lambda w: w != ""))
    count = F.greatest(F.size("__words") - (n - 1), F.lit(1))
    return rows.select(*names, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("__words", i, n)))).alias(out))


def minima(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The least of the text's shingle hashes in each of MINIMA orders."""
    hashes = shingle_hashes(text, words, seed)
    out = np.full(MINIMA, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(out, (hashes[i : i + 4096, None] * FACTORS + SUMMANDS).min(axis=0), out=out)
    return out


def sketch(text: Column, words: int) -> Column:
    """`bands`, a hash of each BAND minima, and `fine`, four bits of every minimum, side by side in numbers."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)

    @F.arrow_udf("struct<fine: array<bigint>, bands: array<bigint>>")
    def sketched(texts: pa.Array) -> pa.Array:
        fine, bands = [], []
        for x in texts:
            least = minima(x.as_buffer().to_pybytes() if x.is_valid else b"", words)
            fine.append(np.bitwise_or.reduce((least & np.uint64(15)).reshape(-1, 16) << shifts, axis=1).view(np.int64))
            bands.append(np.array([xxh64_intdigest(least[i : i + BAND].tobytes(), i) for i in range(0, MINIMA, BAND)], np.uint64).view(np.int64))
        lists = [pa.array(list(rows), pa.list_(pa.int64())) for rows in (fine, bands)]
        return pa.StructArray.from_arrays(lists, ["fine", "bands"])

    return sketched(text)


def agreeing(a: Column, b: Column) -> Column:
    """How many of two texts' minima agree, by their `fine`."""
    out = F.lit(MINIMA)
    for k in range(MINIMA // 16):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2))  # the lowest bit of each four is set if any is
        out = out - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def least_agreeing(similarity: float) -> int:
    """Minima that must agree before sets are compared: of pairs with the similarity, fewer do in one of a thousand."""
    p = similarity + (1 - similarity) / 16
    return int(MINIMA * p - 3.2 * (MINIMA * p * (1 - p)) ** 0.5)


def alike(bodies: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have the similarity, by the sets themselves. bodies: `t` and `text`, one row each."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct(), "asked", "snappy")
    texts = bodies.join(asked, F.col("t") == F.col("of"), "left_semi")
    sets = written(with_word_shingles(texts.select("t", "text"), "text", words, "set"), "shingle-sets")
    both = pairs.join(sets.select(F.col("t").alias("ta"), F.col("set").alias("sa")), F.col("a") == F.col("ta"))
    both = written(both.select("a", "b", "sa"), "first-sets")
    both = both.join(sets.select(F.col("t").alias("tb"), F.col("set").alias("sb")), F.col("b") == F.col("tb"))
    common = F.size(F.array_intersect("sa", "sb"))
    # common stands here once, as each mention makes the intersection anew
    near = F.exists(F.array(common), lambda c: c >= similarity * (F.size("sa") + F.size("sb") - c))
    links = written(both.filter(near).select("a", "b"), "text-links", "snappy")
    for old in (asked, sets):
        discard(old)
    return links


def crowd_of(members: DataFrame) -> DataFrame:
    """(bucket, t, copies, fine) for every text in a bucket with others: its SimHash component, and each of its bands."""
    buckets = F.concat(F.array(F.xxhash64(F.lit("component"), "root")), "bands")
    entries = members.select("t", F.explode(buckets).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("bucket").alias("of"))
    shared = written(shared, "shared-buckets", "snappy")
    crowd = written(entries.join(shared, F.col("bucket") == F.col("of")).select("bucket", "t"), "crowd", "snappy")
    facts = members.select(F.col("t").alias("of"), "copies", "fine")
    return written(crowd.join(facts, F.col("t") == F.col("of")).select("bucket", "t", "copies", "fine"), "sketched-crowd", "snappy")


def hub_pairs(crowd: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b), a < b: every text of a bucket with the bucket's text of most copies, if enough of their minima agree."""
    hubs = crowd.groupBy("bucket").agg(F.max(F.struct("copies", "t", "fine")).alias("hub"))
    hubs = written(hubs.select(F.col("bucket").alias("of"), F.col("hub.t").alias("h"), F.col("hub.fine").alias("hf")), "hubs", "snappy")
    met = crowd.join(hubs, F.col("bucket") == F.col("of")).filter((F.col("t") != F.col("h")) & (agreeing(F.col("fine"), F.col("hf")) >= least))
    return written(met.select(F.least("t", "h").alias("a"), F.greatest("t", "h").alias("b")).distinct(), "hub-pairs", "snappy")


def pairs_left(crowd: DataFrame, roots: DataFrame, compared: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b), with their roots ra and rb, of a bucket but of two components, not compared yet, if enough of their minima agree.

    A bucket's texts meet in blocks of BLOCK, so that no task holds a bucket, and only pairs that pass are listed.
    """
    named = roots.select(F.col("node").alias("of"), "root")
    rows = crowd.join(named, F.col("t") == F.col("of"), "left").select("bucket", "t", "fine", F.coalesce("root", "t").alias("root"))
    rows = written(rows, "rooted-crowd", "snappy")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    mixed = written(mixed.select(F.col("bucket").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed-buckets", "snappy")
    rows = rows.join(mixed, F.col("bucket") == F.col("of")).select("bucket", "t", "fine", "root", F.pmod(F.xxhash64("t"), "blocks").cast("int").alias("block"), "blocks")
    rows = written(rows, "mixed-texts", "snappy")
    text = F.struct("t", "root", "fine")
    one = rows.select("bucket", text.alias("one"), F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    other = rows.select("bucket", text.alias("other"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("x"))
    met = (F.col("one.root") != F.col("other.root")) & ((F.col("x") < F.col("y")) | (F.col("one.t") < F.col("other.t")))
    pairs = one.join(other, ["bucket", "x", "y"]).filter(met & (agreeing(F.col("one.fine"), F.col("other.fine")) >= least))
    ordered = F.when(F.col("one.t") < F.col("other.t"), F.struct("one", "other")).otherwise(F.struct(F.col("other").alias("one"), F.col("one").alias("other")))
    pairs = pairs.select(ordered.alias("p")).select(F.col("p.one.t").alias("a"), F.col("p.other.t").alias("b"), F.col("p.one.root").alias("ra"), F.col("p.other.root").alias("rb"))
    return written(pairs.distinct().join(compared, ["a", "b"], "left_anti"), "pairs-left", "snappy")


def text_groups(members: DataFrame, bodies: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) for every text `t` of members in a group with others: groups are what links between similar texts join."""
    least, crowd = least_agreeing(similarity), crowd_of(members)
    compared = hub_pairs(crowd, least)
    roots = written(connected_components(alike(bodies, compared, words, similarity)), "hub-roots", "snappy")
    rest = pairs_left(crowd, roots, compared, least)
    more = alike(bodies, rest.select("a", "b"), words, similarity).join(rest, ["a", "b"]).select("ra", "rb")
    joined = written(connected_components(more).select(F.col("node").alias("part"), F.col("root").alias("whole")), "joined-roots", "snappy")
    roots = roots.unionByName(joined.select(F.col("part").alias("node"), F.col("part").alias("root"))).distinct()
    return roots.join(joined, F.col("root") == F.col("part"), "left").select("node", F.coalesce("whole", "root").alias("root"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = 4, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates: the first by id, a null id before all.

    Equal texts are one text, named by 128 bits. Two texts are linked if the Jaccard similarity of their shingles of
    `words` words is `similarity` or more, and a group is what links join, so no text goes on its fingerprint alone.
    Texts meet where their SimHashes fall in one component at `most` differing bits, and, as 64 bits find few of the
    pairs at such a similarity, where they share a band of minima of their shingles' hashes. In each bucket all meet
    the text of most copies first; then texts of a bucket that are still in two components meet each other, if enough
    of their minima agree. That is quadratic in a bucket of many texts that are not alike, in minima and not in texts.
    Null texts count as empty, rows equal in id and text as one; an empty table gives an empty result, and columns of
    any name stay as they are.
    """
    own, text_ = own_prefix(docs), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), text_key(text_).alias("t"), fingerprint(F.col(text), shingle).alias("fp"), sketch(F.col(text), words).alias("s"))
    rows = written(rows.select("doc_id", "t", "fp", "s.fine", "s.bands"), "fingerprints", "snappy")
    rooted = components_of(rows.select("doc_id", "fp"), most)
    texts = rows.groupBy("t").agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("fp").alias("fp"), F.any_value("fine").alias("fine"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts.withColumn("first", F.when(F.col("nulls") == 0, F.col("low"))), "texts", "snappy")
    members = written(texts.join(rooted.select("print", "root"), F.col("fp") == F.col("print")).select("t", "copies", "fine", "bands", "root"), "members", "snappy")
    bodies = docs.select(text_key(text_).alias("t"), F.col(key).alias("id"), text_.alias("text"))
    chosen = texts.select(F.col("t").alias("of"), "first")
    bodies = bodies.join(chosen, (F.col("t") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")), "left_semi").select("t", "text").dropDuplicates(["t"])
    groups = written(text_groups(members, bodies, words, similarity).select(F.col("node").alias("of"), F.col("root").alias("group")), "text-groups", "snappy")
    grouped = texts.select("t", "first").join(groups, F.col("t") == F.col("of"))
    keepers = grouped.groupBy("group").agg(F.min(F.struct("first", "t")).alias("x")).select("x.t", "x.first")
    alone = texts.select("t", "first").join(groups, F.col("t") == F.col("of"), "left_anti")
    stay = written(alone.union(keepers).select(F.col("t").alias(f"{own}t"), F.col("first").alias(f"{own}first")), "stay", "snappy")
    kept = docs.withColumn(f"{own}of", text_key(text_)).join(stay, (F.col(f"{own}of") == F.col(f"{own}t")) & F.col(key).eqNullSafe(F.col(f"{own}first"))).drop(f"{own}t", f"{own}first")
    again = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(f"{own}id"), F.col("t").alias(f"{own}again"))
    again = written(again, "rows-again", "snappy")
    same = (F.col(f"{own}of") == F.col(f"{own}again")) & F.col(key).eqNullSafe(F.col(f"{own}id"))
    out = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([key, f"{own}of"]))
    return out.select(*docs.columns)
