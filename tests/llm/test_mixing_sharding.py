import random
import re
import zlib
from collections import Counter, defaultdict

from ledgerline.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """By giving out the excess until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full, free = 1.5 * sum(sizes.values()), {}, dict(weight)
    while True:
        level = (total - sum(full.values())) / sum(free.values()) if free else 0
        above = [s for s in free if free[s] * level > 2 * sizes[s]]
        if not above:
            return full | {s: w * level for s, w in free.items()}
        for s in above:
            full[s] = 2.0 * sizes[s]
            del free[s]


def rows_of():
    random.seed(6)
    text = lambda n: " \t".join(random.choice(["a", "é", "word"]) for _ in range(n))
    rows = [(i, text(random.randint(0, 60)), random.choice(["s1", "s2", "s2", "s2", "z", None])) for i in range(150)]
    return rows + [(3, None, "s1"), (None, text(9), "s2"), (7, "same words here", "z"), (7, "same words here", "z"), (8, "\v", "only blanks"), (500, text(20000), "s3")]


def test_mix_meets_its_targets(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(taken[s] == round(t) for s, t in targets.items())
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rs: sorted(((r.doc_id, r.text, r.taken) for r in rs), key=repr)
    assert key(again) == key(got)
    words = Counter()
    for r in mixing.mixed_rows(mixing.mix(df), ["doc_id", "text", "source"]).collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(df.limit(0)).collect() == []


def test_shards_follow_the_key_and_slots_have_no_gaps(spark):
    rows = [(i % 400, f"text é {i % 50}", "x") for i in range(600)] + [(None, None, "y")] * 40 + [(5, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_documents(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(df.limit(0)).collect() == []


def test_weights_draw_keys_in_proportion(spark):
    df = sharding.assign_shards(spark.range(30000), "id", [1.0, 2.0, 5.0])
    n = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert abs(n[0] - 3750) < 300 and abs(n[1] - 7500) < 400 and abs(n[2] - 18750) < 500


def test_the_winning_shard_by_brute_force(spark):
    """Every key's scores computed by the xxhash library, for equal and unequal weights, a null key, and the largest hash."""
    import math
    import struct

    import xxhash

    ids = [*range(400), None, -5, 1 << 62]
    df = spark.createDataFrame([(i, 1) for i in ids], "id long, offset int")
    for weights in ([1.0] * 16, [0.5, 3.0, 1.0]):
        got = {r["id"]: r["shard"] for r in sharding.assign_shards(df, "id", weights).collect()}
        for i in ids:
            seed = 42 if i is None else xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
            scores = []
            for shard, w in enumerate(weights):
                u = ((xxhash.xxh64(struct.pack("<i", shard), seed=seed).intdigest() >> 12) + 0.5) / 2**52
                scores.append((-w / math.log(u), shard))
            assert got[i] == max(scores)[1]
    assert math.log(((2**52 - 1) + 0.5) / 2**52) < 0 and math.log(0.5 / 2**52) > -40


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 7, 8, 9) for i in range(30)], "doc_id long, text string, source string, offset int, target int, size int")
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "offset", "size", "source_size", "target", "budget", "taken"] and {r["offset"] for r in got.collect()} == {7}
    rows = sharding.with_slots(df.select("doc_id", "offset", (df.doc_id % 3).alias("shard")), "shard").collect()
    assert len(rows) == 30 and {r["offset"] for r in rows} == {7} and sorted(r["slot"] for r in rows if r["shard"] == 1) == list(range(10))
