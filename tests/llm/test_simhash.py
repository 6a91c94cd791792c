import itertools
import random

import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\v\f\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=2):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(parent)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= most:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {p: root(p) for p in nodes}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    comp = plain_components([p for _, p in prints])
    first = {}
    for i, p in prints:
        if i is not None:
            first[comp[p]] = min(first.get(comp[p], i), i)
    expected = sorted(((i, p - (1 << 64) if p >> 63 else p, first.get(comp[p])) for i, p in prints), key=repr)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=repr) == expected


def test_matches_brute_force_with_edge_cases(spark):
    random.seed(3)
    base = [" ".join(random.choice("alpha beta Gamma delta été ß".split()) + str(random.randrange(40)) for _ in range(60)) for _ in range(6)]
    rows = [(i, t, "x") for i, t in enumerate(base)]
    for k in range(40):
        words = base[k % 6].split(" ")
        words[random.randrange(60)] = "edit"
        rows.append((100 + k, " ".join(words), None))
    rows += [(7, base[0], "y"), (7, base[0], "y"), (None, base[1], None), (50, None, None), (51, "", None), (52, " \t\n", None), (53, "two words", None), (54, "TWO\vWORDS", None), (55, "word " * 20000, None), (None, "alone and without id here", None)]
    check(spark, rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def test_few_fingerprints_have_small_plans(spark):
    for most in (2, 4):
        for n in range(3):
            df = spark.createDataFrame([(x, 1) for x in (5, 7)[:n]], "fp long, first long")
            links = simhash.near_links(df, most)
            assert len(links._jdf.queryExecution().logical().toString()) < 50_000
            assert [tuple(sorted(x)) for x in links.collect()] == ([(5, 7)] if n == 2 else [])


def test_flipped_bits_of_a_part(spark):
    df = spark.createDataFrame([(-5,)], "fp long")
    for part, most in (([0, 3, 63], 2), ([1, 2, 5, 9], 3), ([7, 8], 0), (list(range(16)), 4)):
        mask = sum(1 << b for b in part)
        own = -5 % 2**64 & mask
        values = {x.v % 2**64 for x in simhash.flipped(df, 1, part, most).collect()}
        assert values == {own ^ sum(1 << b for b in bits) for k in range(most + 1) for bits in itertools.combinations(part, k)}


def test_crowded_parts_are_linked_through_points(spark):
    random.seed(5)
    base = [random.getrandbits(63) for _ in range(3)]
    prints = set(base)
    for _ in range(300):
        x = random.choice(sorted(prints))
        for _ in range(random.randint(1, 4)):
            x ^= 1 << random.randrange(63)
        prints.add(x)
    df = spark.createDataFrame([(p, 1) for p in prints], "fp long, first long")
    for most, bucket in ((2, 1), (2, 10**6), (4, 20)):
        roots = {r.node: r.root for r in connected_components(simhash.near_links(df, most, bucket)).collect()}
        assert {p: roots.get(p, p) for p in prints} == plain_components(prints, most), (most, bucket)


def test_thresholds_add_up_and_parts_cover_the_bits():
    work = [{t: float(10 ** (t + 1) * (i + 1)) for t in range(-1, 3)} for i in range(3)]
    _, chosen = simhash.allocated(work, 2)
    assert sum(chosen) == 0
    import numpy as np

    both = np.eye(64) * 5 + 5
    for n in (2, 3):
        assert sorted(b for p in simhash.correlated_parts(both, 20, n) for b in p) == list(range(64))


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)


def test_one_of_each_group_stays(spark):
    random.seed(8)
    base = [" ".join(f"w{random.randrange(500)}" for _ in range(300)) for _ in range(4)]
    near = base[0].split(" ")
    near[150] = "edit"
    rows = [(1, base[0]), (2, base[1]), (3, base[2]), (9, base[0]), (4, " ".join(near)), (5, None), (6, ""), (None, base[3]), (None, base[3]), (3, base[2]), (7, "a b"), (8, "A  B")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, t string, print int")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, base[0]), (2, base[1]), (3, base[2]), (5, None), (None, base[3]), (7, "a b")], key=repr)
