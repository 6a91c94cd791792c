"""SpotSigs fingerprints of documents and their near-duplicate classes, in built-in functions only.

A signature is a common word, the anchor, with the next CHAIN content words after it; common words between are
passed over, at most SPAN words are looked at. A document's fingerprint names its set of signatures by 128 bits. A
text without anchors has one signature, of its whole words, so that it equals only its like.

Two documents are near duplicates where the Jaccard similarity of their sets is `similarity` or more. Sets are
partitioned by their length, so that near duplicates are in one partition or in two that follow each other. Each set
is listed under its rarest signatures, as many as two near duplicates can't all differ in, in its own and the next
partition. Those listed together are compared if their lengths allow the similarity: first each with the smallest of
its list; then, in lists that hold several components by then, each with HUBS others, dealt by a hash, of other
components, ROUNDS times over, which joins a crowd of sets that are mostly alike at a cost that grows with the crowd and
not with its pairs; then, in lists that still hold several components, all of different components, in blocks. A pair
is passed over by the sets' bitmaps, of WORDS * 64 bits, each signature flipping one: where they differ in more bits
than two near duplicates can have signatures apart. So every link between different sets is found or lies within a
component; equal sets are one from the start. A list of very many sets that are not alike costs as many comparisons of
bitmaps as it has pairs. A class is a connected component.

A null text is the empty text, which has the one signature of no words. Very long texts need memory in proportion to
their own length. Keys are whole numbers; rows equal in key and text get equal results. Only key and text are read, so
that names of other columns clash with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import GAP, discard, written
from .components import connected_components

#: Common words of English, German, French and Spanish: fixed values.
ANCHORS = (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was we were with you "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "ce dans elle en est et il la le les pas pour que qui sur un une "
    "al con del el las lo los no por se su y"
).split()
CHAIN = 2
SPAN = 10
#: Documents that share a range of ids in the search for each one's successor.
RANGE_ROWS = 1000
#: Ranges that are looked for, so that their ends are a few megabytes; beyond, ranges grow and their sorts spill.
MOST_RANGES = 1 << 17
SIMILARITY = 0.8
#: Sets of a list that are compared with so many others in one place.
BLOCK = 256
#: Numbers of 64 bits in a set's bitmap.
WORDS = 8
#: Sets of a list that each other one is compared with in a round, and rounds, before all are compared with all.
HUBS = 8
ROUNDS = 2


def signatures(text: Column, frame: DataFrame, name: str) -> DataFrame:
    """frame with an array column `name`: the distinct signature hashes of a text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Punct}+", "")
    frame = frame.withColumn("__w", F.filter(F.split(plain, GAP), lambda w: w != ""))
    word = lambda i: F.get("__w", i)
    places = F.filter(F.transform("__w", lambda w, i: F.when(w.isin(ANCHORS), i)), lambda i: i.isNotNull())
    chain = lambda i: F.slice(F.filter(F.slice("__w", i + 2, F.lit(SPAN)), lambda w: ~w.isin(ANCHORS)), 1, CHAIN)
    found = F.array_distinct(F.transform(places, lambda i: F.xxhash64(word(i), chain(i))))
    frame = frame.withColumn("__s", found)
    return frame.withColumn(name, F.when(F.size("__s") > 0, F.col("__s")).otherwise(F.array(F.xxhash64("__w")))).drop("__w", "__s")


def fingerprint(signs: Column) -> Column:
    """The size of a set of signatures and 128 bits of hashes of its members in order."""
    sixteen = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    ordered = F.sort_array(signs)
    return F.concat(F.size(signs).cast("string"), F.lit("-"), sixteen(F.xxhash64(ordered)), sixteen(F.xxhash64(F.lit(1), ordered)))


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """The Jaccard similarity of two sets; 0 where it can't reach the floor, as their sizes tell."""
    common = F.size(F.array_intersect(a, b))
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return F.when(bound < floor, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """docs (two columns: a whole number as key, text) with the text of the next row by descending key, nulls last, after the last the first's.

    Rows equal in key follow each other by a hash of the text. Rows whose hash falls in a small share of all hashes
    begin ranges of about RANGE_ROWS rows, so ids that are repeated or null are cut by their texts; within a
    range a window finds the next row. Each range also gets a copy of the first row of the next range, behind its own,
    so that its last row has a next one as well.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    at = F.struct(F.col("k").isNull().alias("none"), F.bitwise_not("k").alias("down"), "h")
    one_in = max(RANGE_ROWS, rows.count() // MOST_RANGES)
    begins = rows.filter(F.pmod(F.xxhash64(F.lit("range"), "k", "h"), F.lit(one_in)) == 0)
    begins = begins.agg(F.to_json(F.sort_array(F.collect_set(at)))).first()[0]  # about MOST_RANGES short entries at most
    begins = F.from_json(F.lit(begins), ArrayType(rows.select(at.alias("at")).schema["at"].dataType))
    rows = rows.withColumn("place", place_among(begins, at))
    heads = rows.groupBy("place").agg(F.min(at).alias("head"))
    order = Window.orderBy("place")
    heads = heads.select("place", "head.none", "head.down", "head.h").withColumn("goes_to", F.coalesce(F.lag("place").over(order), F.max("place").over(Window.partitionBy())))
    heads = written(heads.select("place", F.when(~F.col("none"), F.bitwise_not("down")).alias("head_k"), F.col("h").alias("head_h"), "goes_to"), "range-heads", "snappy")
    heads = F.broadcast(heads.withColumnRenamed("place", "head_place"))  # about MOST_RANGES narrow rows at most
    copies = rows.join(heads, (F.col("place") == F.col("head_place")) & F.col("k").eqNullSafe(F.col("head_k")) & (F.col("h") == F.col("head_h")))
    copies = copies.groupBy("goes_to", "k", "h").agg(F.any_value("t").alias("t")).select("k", "t", "h", F.col("goes_to").alias("place"))
    all_rows = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    within = Window.partitionBy("place").orderBy("copy", F.col("k").desc_nulls_last(), "h")
    return all_rows.withColumn(out, F.lead("t").over(within)).filter("copy = 0").select(F.col("k").alias(key), F.col("t").alias(text), out)


def place_among(values: Column, at: Column) -> Column:
    """How many of the sorted values are `at` or less, by binary search; beyond the array's end nothing is less."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_RANGES.bit_length() + 2))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) <= at, n + step).otherwise(n))


def listed(sets: DataFrame, similarity: float) -> DataFrame:
    """(list, id, n): each set of `sets` (id, signs) under each of its rarest signatures, in its length partition and the next.

    Two sets of n and m signatures, n the larger, with the similarity have at least similarity * n in common, so they
    share one of the first n - ceil(similarity * n) + 1 of each, in any one order of all signatures.
    The order is by how many sets have a signature; those of one set alone list nothing.
    """
    rows = sets.select("id", F.size("signs").alias("n"), F.explode("signs").alias("s"))
    counts = rows.groupBy("s").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select(F.col("s").alias("of"), "sets")
    counts = written(counts, "signature-counts", "snappy")
    counted = rows.join(counts, F.col("s") == F.col("of")).select("id", "n", F.struct("sets", "s").alias("x"))
    n = F.col("n")
    length = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / similarity)) + F.lit(1e-9)).cast("int")
    first = (n - F.ceil(similarity * n - F.lit(1e-9)) + 1).cast("int")
    rare = counted.groupBy("id", "n").agg(F.sort_array(F.collect_list("x")).alias("rare"))  # one set's signatures without its own, which come first
    shared = F.greatest(first - (n - F.size("rare")), F.lit(0))
    rows = rare.select("id", "n", length.alias("length"), F.explode(F.slice("rare", F.lit(1), shared)).alias("x")).select("id", "n", "length", "x.s")
    return rows.select("id", "n", F.explode(F.array(F.xxhash64("s", "length"), F.xxhash64("s", F.col("length") + 1))).alias("list"))


def bit_words(s: str, words: int = WORDS) -> list[Column]:
    """Aggregates b0, b1, ...: numbers in which each of a set's signatures `s` has flipped one bit of words * 64."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({s}, 64) AS INT))")
    at = F.pmod(F.shiftright(s, 6), F.lit(words))
    return [F.bit_xor(F.when(at == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(words)]


def bits_of_words(words: int = WORDS) -> Column:
    return F.struct(*[f"b{k}" for k in range(words)]).alias("bits")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(of, bits): the bitmap of each set.

    The bits in which two bitmaps differ are never more than the signatures that only one of the sets has.
    """
    rows = sets.select("id", F.explode("signs").alias("s"))
    return rows.groupBy("id").agg(*bit_words("s")).select(F.col("id").alias("of"), bits_of_words())


def bits_apart(a: Column, b: Column, words: int = WORDS) -> Column:
    out = F.lit(0)
    for k in range(words):
        out = out + F.bit_count(a[f"b{k}"].bitwiseXOR(b[f"b{k}"]))
    return out


def alike(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct(), "asked", "snappy")
    asked_sets = written(sets.join(asked, F.col("id") == F.col("of"), "left_semi"), "asked-sets")
    both = pairs.join(asked_sets.select(F.col("id").alias("ia"), F.col("signs").alias("sa")), F.col("a") == F.col("ia"))
    both = both.join(asked_sets.select(F.col("id").alias("ib"), F.col("signs").alias("sb")), F.col("b") == F.col("ib"))
    links = written(both.filter(likeness(F.col("sa"), F.col("sb"), similarity) >= similarity).select("a", "b"), "links", "snappy")
    discard(asked)
    discard(asked_sets)
    return links


def set_classes(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) for each id of `sets` (id, signs; every set once) that is linked to another, root the smallest id of its class."""
    entries = every = written(listed(sets, similarity), "lists", "snappy")
    shared = written(entries.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one")).filter("n > 1").select(F.col("list").alias("of"), F.col("n").alias("sets"), "one"), "shared-lists", "snappy")
    entries = written(entries.join(shared, F.col("list") == F.col("of")).select("list", "id", "n", "sets", "one"), "listed", "snappy")
    discard(every)
    discard(shared)
    firsts = entries.select(F.col("id").alias("of"), F.col("n").alias("m")).distinct()
    pairs = written(entries.filter(F.col("id") != F.col("one")).select(F.col("one").alias("a"), F.col("id").alias("b"), "n").distinct(), "first-pairs", "snappy")
    sizes = written(firsts, "sizes", "snappy")
    pairs = pairs.join(sizes, F.col("a") == F.col("of")).filter(F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b")
    pairs = written(pairs, "pairs", "snappy")
    roots = written(connected_components(alike(sets, pairs, similarity)), "roots", "snappy")
    rows = entries.join(roots, F.col("id") == F.col("node"), "left").select("list", "id", "n", "sets", F.coalesce("root", "id").alias("root"))
    rows = written(rows, "rooted", "snappy")
    mixed = written(rows.groupBy("list").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select(F.col("list").alias("of")), "mixed", "snappy")
    blocks = F.ceil(F.col("sets") / BLOCK).cast("int")
    rows = rows.join(mixed, F.col("list") == F.col("of"), "left_semi").select("list", "id", "n", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    rows = written(rows, "mixed-sets", "snappy")
    asked = written(rows.select(F.col("id").alias("of")).distinct(), "mixed-asked", "snappy")
    maps = written(bitmaps(sets.join(asked, F.col("id") == F.col("of"), "left_semi")), "bitmaps", "snappy")
    rows = written(rows.join(maps, F.col("id") == F.col("of")).drop("of"), "mapped-sets", "snappy")
    links, compared = roots.select(F.col("root").alias("a"), F.col("node").alias("b")), pairs
    for turn in range(ROUNDS):
        if rows.isEmpty():
            break
        met = written(hub_pairs(rows, similarity, turn).join(compared, ["a", "b"], "left_anti"), "hub-pairs", "snappy")
        found = alike(sets, met.select("a", "b"), similarity)
        rows = merged(rows, found.join(met, ["a", "b"]).select("ra", "rb"))
        links, compared = links.union(found), compared.union(met.select("a", "b"))
    rest = written(all_pairs(rows, similarity).join(compared, ["a", "b"], "left_anti"), "rest", "snappy")
    return written(connected_components(links.union(alike(sets, rest, similarity))), "classes", "snappy")


def may_be_alike(one: str, other: str, similarity: float, words: int = WORDS) -> Column:
    """Whether two structs (id, n, root, bits) are of different components and can be alike by their sizes and bitmaps."""
    of = lambda side, part: F.col(f"{side}.{part}")
    sizes = F.least(of(one, "n"), of(other, "n")) >= similarity * F.greatest(of(one, "n"), of(other, "n"))
    most_apart = (of(one, "n") + of(other, "n")) * ((1 - similarity) / (1 + similarity)) + F.lit(1e-9)
    return (of(one, "root") != of(other, "root")) & sizes & (bits_apart(of(one, "bits"), of(other, "bits"), words) <= most_apart)


def hub_pairs(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b), a < b, with a root of each, ra and rb: each set of a list with up to HUBS of the list's, others in each turn.

    rows: (list, id, n, root, bits). A list's hubs are the least by a hash in each of HUBS shares that the hash deals.
    """
    entry = rows.select("list", F.struct("id", "n", "root", "bits").alias("one"), F.xxhash64("id", F.lit(turn)).alias("h"))
    shares = [F.min_by(F.when(F.pmod("h", F.lit(HUBS)) == k, F.col("one")), F.when(F.pmod("h", F.lit(HUBS)) == k, F.col("h"))) for k in range(HUBS)]
    hubs = entry.groupBy("list").agg(F.array_compact(F.array(*shares)).alias("hubs")).select(F.col("list").alias("of"), F.explode("hubs").alias("hub"))
    hubs = written(hubs, "hubs", "snappy")
    met = entry.join(hubs, (F.col("list") == F.col("of")) & may_be_alike("one", "hub", similarity))
    low, high = (lambda part: F.least(f"one.{part}", f"hub.{part}")), (lambda part: F.greatest(f"one.{part}", f"hub.{part}"))
    return met.select(low("id").alias("a"), high("id").alias("b"), low("root").alias("ra"), high("root").alias("rb")).distinct()


def merged(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (list, ..., root), their components joined by pairs of roots, of those lists that still hold several."""
    joined = written(connected_components(roots).select(F.col("node").alias("part"), F.col("root").alias("whole")), "joined-roots", "snappy")
    rows = written(rows.join(joined, F.col("root") == F.col("part"), "left").withColumn("root", F.coalesce("whole", "root")).drop("part", "whole"), "merged-sets", "snappy")
    several = rows.groupBy("list").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select(F.col("list").alias("of"))
    several = written(several, "still-mixed", "snappy")
    return written(rows.join(several, F.col("list") == F.col("of"), "left_semi"), "mixed-sets", "snappy")


def all_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets of one list and different components that can be alike, met in blocks."""
    one = rows.select("list", F.struct("id", "n", "root", "bits").alias("one"), F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    other = rows.select("list", F.struct("id", "n", "root", "bits").alias("other"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("x"))
    once = (F.col("l.x") < F.col("l.y")) | (F.col("one.id") < F.col("other.id"))
    same = (F.col("l.list") == F.col("r.list")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y"))
    met = one.alias("l").join(other.alias("r"), same & once & may_be_alike("one", "other", similarity))
    return met.select(F.least("one.id", "other.id").alias("a"), F.greatest("one.id", "other.id").alias("b")).distinct()


def with_classes(rows: DataFrame, key: str = "doc_id", signs: str = "own", similarity: float = SIMILARITY) -> DataFrame:
    """rows with class_id, the smallest key of the row's near-duplicate class, itself included; the rows' `fingerprint` names their sets.

    rows are read several times, so they should stand in files.
    """
    names = written(rows.groupBy("fingerprint").agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"))).alias("x")).select(F.col("fingerprint").alias("of"), F.col("x.key").alias("first")), "set-names", "snappy")
    names = written(names.withColumn("id", F.monotonically_increasing_id()), "set-ids", "snappy")
    sets = rows.select(key, "fingerprint", signs).join(names, (F.col("fingerprint") == F.col("of")) & F.col(key).eqNullSafe(F.col("first")))
    sets = written(sets.groupBy("id").agg(F.any_value(signs).alias("signs")), "sets")
    classes = set_classes(sets, similarity)
    discard(sets)
    named = names.join(classes, F.col("id") == F.col("node"), "left").select("of", "first", F.coalesce("root", "id").alias("root"))
    least = written(named.groupBy("root").agg(F.min("first").alias("class_id")).withColumnRenamed("root", "class"), "class-names", "snappy")
    named = written(named.join(least, F.col("root") == F.col("class")).select("of", "class_id"), "set-classes", "snappy")
    return rows.join(named, F.col("fingerprint") == F.col("of")).drop("of")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fingerprint, class_id) for every row of docs."""
    rows = signatures(F.col("text"), docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "own")
    rows = written(rows.select("doc_id", fingerprint(F.col("own")).alias("fingerprint"), "own"), "signed")
    return with_classes(rows, similarity=similarity).select("doc_id", "fingerprint", "class_id")


def edited_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of the text with its last half replaced by the next document's start, how alike they are, and class_id."""
    rows = with_next(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "next")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = signatures(F.col("text"), rows, "own").drop("text")
    rows = signatures(F.col("edited"), rows, "changed")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = signatures(F.col("next"), rows, "following")
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        "own",
    )
    return with_classes(written(rows, "signed")).drop("own")
