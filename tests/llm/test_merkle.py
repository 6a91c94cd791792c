"""The Merkle manifest against a plain recursion, for ragged trees of every shape."""

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from ledgerline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, part int, key string"


def h(text):
    return sha256(text.encode()).hexdigest()


def tree(digests):
    """The root, and each leaf's runs and places on the way up."""
    ways, level, at = [[] for _ in digests], digests, list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(at):
            ways[i].append((p % 16, level[p // 16 * 16 : p // 16 * 16 + 16]))
        level, at = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [p // 16 for p in at]
    return level[0], ways


def brute(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h("".join(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), leaf(r, r["text"] and r["text"].translate(lower))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done[s] = tree([x[1] for x in groups[s]])
    top, above = tree([done[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (k, digest, found), way in zip(groups[s], done[s][1]):
            proof = h("".join("".join(run[:p] + run[p + 1 :]) for p, run in way + up))
            x = found if k is not None and zlib.crc32(str(k).encode()) % 5 == 0 else digest
            for p, run in way + up:
                x = h("".join([*run[:p], x, *run[p + 1 :]]))
            out.append((k, digest, done[s][0], top, proof, x, x == top))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def documents(sizes):
    rows = []
    for s, n in sizes.items():
        for i in range(n):
            text = None if i % 7 == 3 else ("" if i % 11 == 5 else f"Text {s} ü{i} Of LONG")
            rows.append({"doc_id": (1 << 60) + i * 3 + len(rows), "text": text, "lang": None if i % 5 == 0 else "en", "source": s, "n_chars": i, "pos": "x", "part": 1, "key": "y"})
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_equals_plain_recursion(spark):
    rows = documents({None: 1, "": 2, "a": 16, "b": 17, "ü": 300, "z": 1000, **{f"h{i}": 1 + i % 3 for i in range(20)}})
    rows += [dict(rows[5]), dict(rows[5]), dict(rows[30], doc_id=None), dict(rows[40], doc_id=None, text="other")]
    assert result(merkle.documents_manifest(frame(spark, rows))) == brute(rows)


def test_butterfly_of_many_rounds(spark):
    """Partitions of 16 leaves: 5000 leaves make 313 partitions and three rounds, ragged at every level."""
    rows = documents({"hot": 5000, "x": 272, "y": 257})
    docs = frame(spark, rows)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(docs, tampered={"text": merkle.lower_ascii(F.col("text"))}, when=hit, levels=1)
    assert result(got) == brute(rows)


def test_one_row_no_rows_and_a_repeated_row(spark):
    rows = documents({"only": 1})
    assert result(merkle.documents_manifest(frame(spark, rows))) == brute(rows)
    assert result(merkle.documents_manifest(frame(spark, []))) == []
    rows = documents({"only": 1}) * 700
    assert result(merkle.documents_manifest(frame(spark, rows))) == brute(rows)
