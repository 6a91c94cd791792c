"""The set-similarity join of names against all pairs."""

import random

import pytest

from ledgerline.operators import matching


def tidy(name):
    return " ".join(sorted((name or "").lower().split()))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def names(n, seed):
    """Invented names of 1 to 5 words, short and long, and copies with letters lost, added and changed."""
    draw = random.Random(seed)
    words = ["steel", "power", "tata", "om", "a", "bharat", "industries", "ltd", "limited", "foods", "zz", "internationale", "köln", "3m"]
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            name = draw.choice(out)
            for _ in range(draw.randrange(1, 6)):
                k = draw.randrange(len(name) + 1)
                name = draw.choice([name[:k] + draw.choice("abcxyz ") + name[k:], name[:k] + name[k + 1 :], name[:k] + draw.choice("qrs") + name[k + 1 :]]) or "x"
        else:
            name = " ".join(draw.choice(words) for _ in range(draw.randrange(1, 6)))
        out.append(name)
    return out


@pytest.mark.parametrize(("ratio", "q"), [(0.75, 2), (0.6, 1), (0.9, 3), (0.8, 2)])
def test_no_pair_is_lost(spark, ratio, q):
    left = names(160, 1)
    right = names(120, 2) + [n[: i % len(n)] + "w" + n[i % len(n) + i % 2 :] for i, n in enumerate(left[:60]) if n]
    a = spark.createDataFrame([(n,) for n in [*left, None, " "]], "company_name string")
    b = spark.createDataFrame([(n,) for n in [*right, None, ""]], "name string")
    got = {(r["l"], r["r"]): r["score"] for r in matching.similar_names(a, b, ratio, q).collect()}
    want = {}
    for x in {tidy(n) for n in left if tidy(n)}:
        for y in {tidy(n) for n in right if tidy(n)}:
            if (s := 200.0 * lcs(x, y) / (len(x) + len(y))) >= 100 * ratio - 1e-9:
                want[x, y] = s
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_match_equals_that_of_all_pairs(spark):
    asked, known = names(120, 3), names(150, 4)
    left = spark.createDataFrame([(n, str(i)) for i, n in enumerate(asked)] + [(None, "none")], "company_name string, cin string")
    right = spark.createDataFrame([(f"c{i}", n, i) for i, n in enumerate(known)], "code string, name string, place long")
    got = {r["cin"]: (r["code"], r["score"]) for r in matching.fuzzy_match_names(left, right).collect()}
    assert got.pop("none") == (None, None) and len(got) == len(asked)
    for i, n in enumerate(asked):
        scores = [100.0 if tidy(n) == tidy(k) else 200.0 * lcs(tidy(n), tidy(k)) / (len(tidy(n)) + len(tidy(k))) for k in known]
        best = max(scores)
        assert got[str(i)] == ((f"c{scores.index(best)}", round(best, 2)) if best >= 60 else (None, None)), (n, best)


def test_similar_names_are_excluded(spark):
    controls = spark.createDataFrame([("Alpha Steel Ltd", 1), ("Steel Alpha Limited", 2), ("Gamma", 3), (None, 4)], "company_name string, source_row long")
    listed = spark.createDataFrame([("alpha  steell ltd",), (None,)], "company_name string")
    assert sorted(r["source_row"] for r in matching.exclude_similar(controls, listed, 90).collect()) == [2, 3, 4]


def test_names_that_share_a_long_beginning_are_not_compared_with_each_other(spark):
    left = spark.range(400).selectExpr("concat('customer#', lpad(id, 9, '0')) as t")
    right = spark.range(0, 400, 2).selectExpr("concat('xcustomer#', lpad(id, 9, '0')) as t").unionAll(spark.range(1, 400, 2).selectExpr("concat('customer#', lpad(id, 9, '0'), 'q') as t"))
    near = matching.candidates(left, right, 0.95, 3)
    assert near.count() == near.distinct().count() == 400
    assert matching.scored(near, 0.95).count() == 400


@pytest.mark.parametrize("ratio", [0.95, 0.97, 1.0])
def test_no_pair_of_one_letter_too_many_is_lost(spark, ratio):
    made = [n for n in names(150, 5) if tidy(n)]
    more = [n[: i % len(n)] + "w" + n[i % len(n) :] for i, n in enumerate(made)]
    a = spark.createDataFrame([(n,) for n in made], "company_name string")
    b = spark.createDataFrame([(n,) for n in [*made[::2], *more]], "name string")
    got = {(r["l"], r["r"]): r["score"] for r in matching.similar_names(a, b, ratio, 3).collect()}
    texts = lambda rows: {tidy(n) for n in rows}
    want = {(x, y): 200.0 * lcs(x, y) / (len(x) + len(y)) for x in texts(made) for y in texts([*made[::2], *more])}
    want = {k: v for k, v in want.items() if v >= 100 * ratio - 1e-9}
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
