"""Merkle manifest of a dataset: a digest for every row, a tree for every source, a tree over the sources, and proofs.

A leaf is the SHA-256 of a row's fields, each with its length. A source's leaves ascend by the row's id; every
FANOUT consecutive nodes, the last run fewer, become their digest until one node remains. The sources' roots
become the dataset's root in the same way. All digests are lowercase hex, also where they are hashed again.

Leaves are hashed where the texts are read, so that no text is shuffled. Positions come from a range sort and a
prefix sum over the ranges' counts. A partition of the tree holds FANOUT ** LEVELS aligned leaves, whatever the
size of its source, and hashes its own subtree. Then the partitions exchange roots as a butterfly: in round r
the partitions whose numbers differ only in digit r (base FANOUT) swap the roots that they know, and each hashes
the ancestor that they share itself. After the last round every partition knows the root and all siblings on its
way up, so that nothing goes down the tree. In the ragged last run of a round, partitions serve several partners.

A null field is "-". A null source is a source, ordered first. Rows of one id are ordered by their leaf; equal rows
are interchangeable. A null id is never tampered with. An empty table gives an empty manifest. Texts of any length
are hashed whole in the JVM. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

FANOUT = 16
#: Levels of the tree within a partition: FANOUT ** LEVELS leaves.
LEVELS = 3
#: Rows that a range of the sort has on average.
RANGE_ROWS = 20_000
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Places of a monotonically increasing id for the row within its partition: fixed by Spark.
ROW_BITS = 33
STEP = "struct<at:int,run:string>"


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields: "-" for null, else the number of bytes in UTF-8, ":", and the value."""
    parts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def numbered(nodes: DataFrame, what: str) -> DataFrame:
    """nodes (tree, key, digest, ...) with pos, their place within the tree by key and digest, and n, the tree's nodes.

    A range's rows are numbered as they are written; what is added is the count of the tree's earlier ranges. Ties
    of everything are salted, so that one repeated row fills several ranges.
    """
    ranges = -(-nodes.count() // RANGE_ROWS) or 1
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("digest")]
    dealt = nodes.withColumn("__salt", F.rand(11)).repartitionByRange(ranges, *order, F.col("__salt")).sortWithinPartitions(*order)
    rows = written(dealt.drop("__salt").withColumn("__id", F.monotonically_increasing_id()), what)
    rows = rows.withColumns({"__range": F.shiftrightunsigned("__id", ROW_BITS), "__row": F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)})
    runs = rows.groupBy("tree", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    one_tree = Window.partitionBy("tree")
    earlier = one_tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "__range", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__add"), F.sum("__n").over(one_tree).alias("n"))
    rows = rows.join(written(runs, f"{what}-runs"), ["tree", "__range"])
    return rows.withColumn("pos", F.col("__row") + F.col("__add")).drop("__id", "__range", "__row", "__add")


def _levels(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """The nodes of an aligned part of a tree of n leaves, level by level, up to its top or the tree's."""
    out = [digests]
    for _ in range(levels):
        if n == 1:
            break
        below = out[-1]
        out.append([sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
        n = -(-n // FANOUT)
    return out


def partition_roots(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, part, parts, digest) of every partition of FANOUT ** levels aligned nodes."""
    whole = FANOUT**levels

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        first, n = rows.iloc[0], int(rows["n"].iloc[0])
        top = _levels(rows.sort_values("pos")["digest"].tolist(), n, levels)[-1]
        return pd.DataFrame([(first["tree"], int(first["part"]), -(-n // whole), top[0])], columns=["tree", "part", "parts", "digest"])

    rows = nodes.select("tree", F.floor(F.col("pos") / whole).alias("part"), "pos", "n", "digest")
    return rows.groupBy("tree", "part").applyInPandas(root, "tree string, part long, parts long, digest string")


def butterfly(roots: DataFrame, what: str = "butterfly") -> DataFrame:
    """(tree, part, root, path): every partition's ancestors' runs from its own root up to the tree's.

    A step of the path is the run that a node stands in, as one string of digests, and the node's place in it. One
    exchange a round; a row receives at most FANOUT digests. Each round is written, so a lost executor costs one.
    """
    now = written(roots.select("tree", "part", "parts", "digest", F.array().cast(f"array<{STEP}>").alias("path")), what)
    most, span = now.agg(F.max("parts")).first()[0] or 1, 1
    while -(-most // span) > 1:
        now, before = written(_swap(now, span), what), now
        discard(before)
        span *= FANOUT
    return now.select("tree", "part", F.col("digest").alias("root"), "path")


def _swap(now: DataFrame, span: int) -> DataFrame:
    """One round: nodes of `span` partitions each meet in their runs, and every partition hashes its run itself."""
    node, last = F.floor(F.col("part") / span), F.floor((F.col("parts") - 1) / span)
    rows = now.withColumns({"__node": node, "__last": last, "__at": F.col("part") % span})
    size = lambda q: F.least(F.lit(span), F.col("parts") - q * span)
    first = F.floor(F.col("__node") / FANOUT) * FANOUT
    sent = rows.select("*", size(F.col("__node")).alias("__size"), F.explode(F.sequence(first, F.least(first + FANOUT - 1, F.col("__last")))).alias("__to"))
    # a node of fewer partitions than its partner serves more than one of them
    sent = sent.filter(F.col("__at") < size(F.col("__to")))
    sent = sent.select("*", F.explode(F.sequence(F.col("__at"), size(F.col("__to")) - 1, F.col("__size"))).alias("__seat"))
    own = F.col("__to") == F.col("__node")
    got = sent.groupBy("tree", (F.col("__to") * span + F.col("__seat")).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("__node", "digest"))).alias("__run"),
        F.max(F.when(own, F.struct("parts", "path", "digest", "__last"))).alias("__own"),
    )
    run, o = F.array_join(F.transform("__run", lambda x: x["digest"]), ""), F.col("__own")
    more = o["__last"] > 0
    step = F.struct((F.floor(F.col("part") / span) % FANOUT).cast("int").alias("at"), run.alias("run"))
    return got.select(
        "tree", "part", o["parts"].alias("parts"),
        F.when(more, F.sha2(run, 256)).otherwise(o["digest"]).alias("digest"),
        F.when(more, F.concat(o["path"], F.array(step))).otherwise(o["path"]).alias("path"),
    )


def _ways(rows: pd.DataFrame, above: list, levels: int):
    """Per node of a partition, in the order of rows: its runs and its places in them, from the bottom to the root."""
    tree = _levels(rows["digest"].tolist(), int(rows["n"].iloc[0]), levels)
    inner = len(tree) - 1
    joined = [["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)] for level in tree[:inner]]
    above = [(int(s["at"]), s["run"]) for s in above]
    for i in range(len(rows)):
        yield [(i // FANOUT**k % FANOUT, joined[k][i // FANOUT ** (k + 1)]) for k in range(inner)] + above


def _siblings(at: int, run: str) -> str:
    return run[: HEX * at] + run[HEX * (at + 1) :]


def _folded(digest: str, way: list[tuple[int, str]]) -> str:
    for at, run in way:
        digest = sha256((run[: HEX * at] + digest + run[HEX * (at + 1) :]).encode()).hexdigest()
    return digest


def _with_part(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("part", F.floor(F.col("pos") / FANOUT**levels))


def _meet(nodes: DataFrame, paths: DataFrame, made, schema: str, levels: int) -> DataFrame:
    """made(rows by pos, the partition's row of paths) for every partition of the tree."""

    def both(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        return made(rows.sort_values("pos"), path.iloc[0])

    at = ["tree", "part"]
    return _with_part(nodes, levels).groupBy(*at).cogroup(paths.groupBy(*at)).applyInPandas(both, schema)


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, when: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    folded_root is what a checker gets from the row's leaf and its siblings. `tampered` gives columns that a checker
    finds changed in the rows where `when` holds; leaves, roots and proofs are those of the rows as they were.
    """
    kind = dict(docs.dtypes)[key]
    found = leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("tree"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"),
        F.when(F.coalesce(when, F.lit(False)), found).alias("found") if tampered else F.lit(None).cast("string").alias("found"),
    )
    leaves = numbered(written(leaves, "leaves"), "numbered-leaves")
    parts = butterfly(partition_roots(leaves, levels), "butterfly")
    subroots = parts.filter("part = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest"))
    tops = numbered(written(subroots, "subroots"), "numbered-subroots")
    above = butterfly(partition_roots(tops, levels), "butterfly-top")

    def way(rows: pd.DataFrame, path: pd.Series) -> pd.DataFrame:
        ways = [[{"at": a, "run": r} for a, r in w] for w in _ways(rows, path["path"], levels)]
        return pd.DataFrame({"tree": rows["key"].tolist(), "top_path": ways, "top": path["root"]})

    tops = written(_meet(tops, above, way, f"tree string, top_path array<{STEP}>, top string", levels), "source-paths")
    paths = parts.join(tops, "tree").select("tree", "part", "root", "top", F.concat("path", "top_path").alias("path"))

    def proofs(rows: pd.DataFrame, path: pd.Series) -> pd.DataFrame:
        out = []
        for k, digest, changed, w in zip(rows["key"], rows["digest"], rows["found"], _ways(rows, path["path"], levels)):
            proof = sha256("".join(_siblings(*step) for step in w).encode()).hexdigest()
            folded = _folded(changed if isinstance(changed, str) else digest, w)
            out.append((k, digest, path["root"], path["top"], proof, folded, folded == path["top"]))
        return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = _meet(leaves.withColumn("key", F.col("key").cast("string")), paths, proofs, schema, levels)  # as text, as pandas would make long keys with nulls floats
    return rows.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against texts of which a fifth, by the id's CRC-32, have become lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, tampered={"text": lower_ascii(F.col("text"))}, when=hit)
