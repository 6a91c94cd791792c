import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import suffix


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), len(kept)))
    return out


def check(spark, texts, length, **sizes):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, k int, size int")
    rows = suffix.repeat_report(df, length=length, **sizes).collect()
    got = {r.doc_id: tuple(r)[1:6] for r in rows}
    assert [got[i] for i in range(len(texts))] == plain(texts, length)
    for r in rows:
        if r.n_removed == 0:
            assert r.kept_text == (texts[r.doc_id] or "")
        if "\ufffd" not in r.kept_text:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def corpus():
    random.seed(11)
    words = [w + str(i) for i in range(60) for w in ("al", "béta", "g", "delta")]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage = text(40)
    texts = [text(random.randint(1, 120)) for _ in range(20)]
    texts += [f"{text(random.randint(0, 9))} {passage} {text(random.randint(0, 9))}" for _ in range(25)]
    near = text(90).split(" ")
    for _ in range(12):
        copy = list(near)
        copy[random.randrange(90)] = "x"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[3] + texts[3], "ab" * 300, "z" * 500, "", None, "short", "é" * 150, passage, passage[:-1], text(4000)]
    return texts


@pytest.mark.parametrize("sizes", [{}, {"crowd": 3}, {"bucket_bytes": 2000}])
def test_matches_brute_force(spark, sizes):
    check(spark, corpus(), 100, **sizes)


def test_whole_small_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts, 400)


def test_empty_table(spark):
    assert suffix.repeat_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_run_length_index_gives_the_longest_other_match():
    random.seed(2)
    for _ in range(60):
        contents = ["".join(random.choice("ab") for _ in range(random.randint(1, 25))).encode() for _ in range(random.randint(1, 6))]
        got, at = suffix.match_lengths(contents), 0
        starts = [(c, i) for c in range(len(contents)) for i in range(len(contents[c]))]

        def common(a, b):
            x, y = contents[a[0]][a[1] :], contents[b[0]][b[1] :]
            return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

        for c, content in enumerate(contents):
            for i in range(len(content)):
                assert got[at + i] == max((common((c, i), o) for o in starts if o != (c, i)), default=0)
            at += len(content) + 1


def test_windows_are_in_one_segment_each():
    random.seed(4)
    for n in (99, 100, 101, 500, 3000):
        raw = bytes(random.choice(b"abc") for _ in range(n))
        at, count, _ = suffix.segments_of(raw, 100)
        assert [x for a, c in zip(at, count) for x in range(a, a + c)] == list(range(max(0, n - 99)))
