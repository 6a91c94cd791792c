import random

from ledgerline.llm import spotsigs


def test_lists_are_made_once_of_shared_signatures(spark, monkeypatch):
    """A set's own signatures come first in its order and list nothing, so they need no second shuffle; the classes are those of all pairs."""
    rng, plans, written = random.Random(4), [], spotsigs.written
    sets = []
    for k in range(60):
        base = [rng.getrandbits(62) for _ in range(rng.randint(1, 40))]
        sets += [base, [x if rng.random() < 0.93 else rng.getrandbits(62) for x in base] + [rng.getrandbits(62)] * (k % 2)]
    sets = [sorted(set(x)) for x in {tuple(sorted(set(x))) for x in sets}]

    def spied(df, what, *a):
        plans.append((what, df._jdf.queryExecution().toString()))
        return written(df, what, *a)

    monkeypatch.setattr(spotsigs, "written", spied)
    got = {r["node"]: r["root"] for r in spotsigs.set_classes(spark.createDataFrame(list(enumerate(sets)), "id long, signs array<long>")).collect()}
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            common = len(set(sets[a]) & set(sets[b]))
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert any(r != i for i, r in enumerate(root)) and [got.get(i, i) for i in range(len(sets))] == root
    counted = [(what, plan) for what, plan in plans if "/signature-counts-" in plan]
    assert [what for what, _ in counted] == ["lists"] and "LeftOuter" not in counted[0][1]
