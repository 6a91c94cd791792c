import random

from pyspark.sql import functions as F

from ledgerline.llm import simhash


def test_a_component_of_six_groups_is_settled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle: F.lit(7).cast("long"))  # one component
    rows = [(10 * g + k, " ".join(f"g{g}w{i}" for i in range(40)) + f" end{k}") for g in range(6) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [10 * g for g in range(6)]


def test_one_of_each_group_against_all_pairs(spark):
    """Families edited to similarities around 0.8: 98 % of the pairs at 0.8 or more are in one group, and no others are linked."""
    rng, rows = random.Random(4), []
    for family in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 120, 400)))]
        for k in range(5):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 60) if k else 0):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            if k == 4:  # a block of its own at the end
                cut = int(len(text) * rng.uniform(0.85, 0.98))
                text[cut:] = [f"own{rng.randrange(10**6)}" for _ in text[cut:]]
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = list(range(len(rows)))
    for i, j in near:
        a, b = sorted((group[i], group[j]))
        group = [a if g == b else g for g in group]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {i for i, g in enumerate(group) if i == g}
    assert 100 < len(near) and len(expected) < len(rows) - 50
    assert expected <= kept and len(kept - expected) <= 0.02 * len(near)


def test_a_crowd_of_texts_that_are_not_alike(spark, monkeypatch):
    """One fingerprint for all, more texts than a block holds, pairs of near copies among them: every pair is found, no other goes."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle: F.lit(7).cast("long"))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    shared = [f"s{i}" for i in range(30)]
    rows = [(2 * g + k, " ".join([*shared, *(f"g{g}w{i}" for i in range(60)), f"end{k}"])) for g in range(40) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __t", "2 as __first", "3 as fine", "4 as s")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2 * g for g in range(40)]
