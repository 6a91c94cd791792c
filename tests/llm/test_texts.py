import hashlib
import os
import pathlib
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerline.llm import licenses, lines, spotsigs

SF = "/root/testdata/sf0.001"


def rewrapped(text, width):
    """The text's words in lines of another width, without its commas, quotes and blank lines."""
    words, lines = re.sub("[,;'\"“”]", "", text).split(), [""]
    for w in words:
        lines = [*lines[:-1], f"{lines[-1]} {w}"] if len(lines[-1]) + len(w) < width else [*lines, w]
    return "\n".join(lines)


def test_licenses_by_canonical_text(spark):
    rows, expected = [], {}
    add = lambda text, license_id, notices="": expected.update({len(rows): (license_id, notices)}) or rows.append((len(rows), text))
    for name, text in licenses.TEXTS:
        add(text, name)
    for name, text in licenses.LICENSES.items():
        add("Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + text.replace(" ", "  ").upper(), name, "all-rights-reserved")
        add(rewrapped(text, 30), name)
        add(rewrapped(text, 77).replace("license", "licence").replace("\n", "\n * "), name)
        add(text + " And one more word.", None)
        add(text[:10] + "q" + text[10:], None)
    folder = "/usr/share/common-licenses"
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{file}"):
            text = pathlib.Path(f"{folder}/{file}").read_text()
            add(text, name)
            add(text.upper().replace("\n\n", "\n\n\n"), name)
    add("text\nReleased under the MIT Licence!\nAll rights reserved " + "-" * 150, None, "MIT,all-rights-reserved")
    add("x\n// SPDX-License-Identifier: BSD-3-Clause\nThis software is distributed under\nLicensed under the terms of the GNU General Public License, version 3", None, "BSD-3-Clause,GPL-3.0")
    add("This work is licensed under the MIT License and others", None)
    for text in (None, "", "Copyright 2020 B", "word " * 30000, "likewise\nnoise"):
        add(text, None)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license_id string")
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    assert {i: (r.license_id, r.notice_ids) for i, r in got.items()} == expected
    twice = spark.createDataFrame([(None, "x"), (1, "likewise noise"), (1, "likewise\n noise,"), (1, "likewise noise")], "doc_id long, text string")
    out = licenses.scanned(twice).collect()
    assert len(out) == 4 and len({r.canonical_digest for r in out}) == 2
    assert licenses.scanned(df.limit(0)).collect() == []


def test_spotsigs_next_document_and_likeness(spark):
    random.seed(5)
    rows = [(i * 3 % 7919, " ".join(random.choice(["the", "and", "of", "x%d" % random.randrange(300), "Ünd,"]) for _ in range(random.randint(0, 30)))) for i in range(2500)]
    rows += [(None, "null id"), (9000, None), (9001, "the " * 12000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, next int")
    got = {r.doc_id: r for r in spotsigs.edited_report(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == text:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert spotsigs.edited_report(df.limit(0)).collect() == []


ANCHORS = set(spotsigs.ANCHORS)


def plain_signatures(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[!-/:-@\\[-`{-~]+", "", (text or "").lower())) if w]
    found = {(w, *[x for x in words[i + 1 : i + 11] if x not in ANCHORS][:2]) for i, w in enumerate(words) if w in ANCHORS}
    return frozenset(found or {("whole text", *words)})


def plain_likeness(a, b):
    return len(a & b) / len(a | b)


def test_spotsigs_match_brute_force(spark):
    rng = random.Random(6)
    vocab = ["the", "and", "of", "der", "que"] * 20 + [f"x{i}" for i in range(400)] + ["Ünd,", "It's"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(n) for n in (30, 60, 120, 240, 240, 400)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(240):  # groups that grow together, and fade out of each other's reach
        words = rng.choice(rows)[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((10 + i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "!"), (903, "no common word"), (904, "No common, word"), (905, "the end"), (906, "the end"), (None, "the end"), (None, base[0]), (907, text(9000)), (5, base[1])]
    sets = [plain_signatures(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if plain_likeness(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, own int, fingerprint string")
    got = spotsigs.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(d), str(least.get(root(i)))) for i, (d, _) in enumerate(rows))
    assert len(set(least.values())) > 20
    names = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            names[r.doc_id] = r.fingerprint
    same = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and d != 5:
            assert same.setdefault(sets[i], names[d]) == names[d]
    assert len(set(same.values())) == len(same)
    assert spotsigs.near_duplicates(df.limit(0)).collect() == []


def test_spotsigs_report_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in spotsigs.edited_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        own, edited, following = (plain_signatures(x) for x in (text, text[: len(text) - half] + after[:half], after))
        assert abs(got[i].near_edited - plain_likeness(own, edited)) < 1e-9 and abs(got[i].near_next - plain_likeness(own, following)) < 1e-9


def plain_lines(rows, similarity=0.8):
    """All pairs of lines by their shingle sets; the first of each component stays."""
    import re

    def norm(x):
        return re.sub("[!-/:-@\\[-`{-~\x20\x09-\x0D]+", " ", x.lower()).strip(" ")

    places = {}
    for d, text in rows:
        for k, x in enumerate((text or "").split("\n")):
            n = norm(x)
            if len(n) >= 16:
                places.setdefault(n, []).append(((d is not None, d or 0), text, k))
    sets = {n: {n[m.start() : m.start() + 9] for m in re.finditer("[^ ]+", n)} for n in places}
    names, parent = list(sets), {n: n for n in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    groups = {}
    for n, at in places.items():
        groups.setdefault(root(n), []).extend(at)
    gone = {}
    for at in groups.values():
        first = min((d, k) for d, _, k in at)
        for d, text, k in at:
            if (d, k) != first:
                gone.setdefault((d[1] if d[0] else None, text), set()).add(k)
    return gone


def test_fuzzy_lines_match_all_pairs(spark):
    random.seed(12)
    vocab = [a + b for a in ("river", "stone", "cloud", "amber", "quiet") for b in ("walk", "song", "light", "mill", "gate", "ward")]
    line = lambda n=25: " ".join(random.choice(vocab) for _ in range(n))
    base = [line() for _ in range(12)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(random.randint(0, 3))]
        words = random.choice(base).split(" ")
        words[random.randrange(25)] = "edit%d" % random.randrange(4)
        own.insert(0, " ".join(words).upper() + "!")
        rows.append((i, "\n".join([*own, "", "short"])))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "word " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string")
    got = {(r.doc_id, r.text): set(r.removed) for r in lines.with_removed(df).collect() if r.removed}
    expected = plain_lines(rows)
    assert all(gone <= expected.get(k, set()) for k, gone in got.items())  # nothing goes that isn't like an earlier line
    assert sum(map(len, got.values())) >= 0.95 * sum(map(len, expected.values()))
    out = lines.deduplicated(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert lines.deduplicated(df.limit(0)).collect() == []


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_take_hostile_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "same words in this line of text again\n" * 3, "en", "s", 5), (1, "same words in this line of text again\n" * 3, "en", "s", 5), (2, "w " * 20000, None, None, 3), (3, "a quiet line of twelve words or so that stands here alone today", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as size", "2 as removed", "3 as kept")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
        out = stage(spark, docs, SF)
        out.collect()


def test_notices_of_long_spellings_and_copyright_lines(spark):
    """A notice of nothing but spellings that are a quarter longer than their form finds itself and its form; owners' lines go in every form."""
    notices = [("long", " ".join(["programme"] * 20)), ("pct", " ".join(["whilst per cent"] * 9))]
    mit = licenses.LICENSES["MIT"]
    heads = ["Copyright Jane Doe 2020", "Copyright by Jane", "Portions Copyright (c) 2020 Jane", "Copyright (c) 2020, 2021 Jane Doe", "© 2019 Jane", "Parts Copyright Acme Inc. 1999-2003"]
    rows = [(0, notices[0][1]), (1, " ".join(["program"] * 20)), (2, "x\n" + notices[1][1].upper() + "\ny"), (3, "programme"), *[(10 + i, f"{h}\n{mit}") for i, h in enumerate(heads)], (30, f"Copyright notice of 7 parts\n{mit}")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), notices=notices).collect()}
    assert [got[i].notice_ids for i in range(4)] == ["long", "long", "pct", ""]
    assert {got[10 + i].license_id for i in range(len(heads))} == {"MIT"} and got[30].license_id is None


def test_spotsigs_crowd_around_the_threshold(spark):
    """Sets of one list, most pairs near 0.8: the classes of all pairs, and few pairs left for the comparison of all."""
    rng = random.Random(5)
    base, rows = list(range(1000, 1060)), [(0, [1, *range(5000, 5047)] + list(range(1000, 1012)))]
    for i in range(1, 400):
        rows.append((i, sorted(rng.sample(base, 60 - rng.randint(3, 9))) + [7000 + i % 40]))
    rows += [(400 + i, [1000, 20_000 + i, *range(30_000 + 100 * i, 30_040 + 100 * i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, signs array<long>")
    sets, root = [set(x) for _, x in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i: top(i) for i in range(len(rows))}
    linked = {x for i, x in want.items() if x != i}
    got = {r.node: r.root for r in spotsigs.set_classes(df).collect()}
    assert got == {i: x for i, x in want.items() if x != i or i in linked}
    assert len(linked) < len(got) < len(rows)


def test_spotsigs_hub_pairs_are_linear(spark):
    """Each set of a crowded list meets HUBS others at most, and equal components meet nothing."""
    rows = [("x", i, 10, i % 300, tuple([0] * spotsigs.WORDS)) for i in range(600)]
    bits = "struct<" + ",".join(f"b{k}:long" for k in range(spotsigs.WORDS)) + ">"
    df = spark.createDataFrame(rows, f"list string, id long, n int, root long, bits {bits}")
    pairs = spotsigs.hub_pairs(df, 0.8, 0).collect()
    assert 0 < len(pairs) <= 600 * spotsigs.HUBS and all(p.a < p.b and p.ra < p.rb for p in pairs)
    assert {x for p in pairs for x in (p.a, p.b)} == set(range(600))
    assert spotsigs.hub_pairs(df.withColumn("root", F.lit(1)), 0.8, 0).collect() == []
    assert spotsigs.hub_pairs(df.limit(0), 0.8, 0).collect() == []


def test_spotsigs_next_document_over_ranges(spark, monkeypatch):
    """Ranges of three rows: repeated and null ids are cut by their texts, and every row meets the next one."""
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 3)
    rows = [(i, f"t{i}") for i in range(0, 120, 2)] + [(50, f"again {i}") for i in range(40)] + [(None, f"none {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    got = sorted(((r.id, r.text, r.next) for r in spotsigs.with_next(df, "id", "text", "next").collect()), key=repr)
    assert got == sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=repr)
    values = F.from_json(F.lit("[1, 4, 4, 9]"), "array<long>")
    places = spark.range(12).select(spotsigs.place_among(values, F.col("id")).alias("n")).collect()
    assert [r.n for r in places] == [0, 1, 1, 1, 3, 3, 3, 3, 3, 4, 4, 4]
    assert spotsigs.with_next(df.limit(0), "id", "text", "next").collect() == []
