"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from ledgerline.llm import flatgraph


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "a", 7, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cell string, uid int, copies int")


def brute(rows, least=0.9):
    """(n_links, component_id) by row, from all pairs."""
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label)}
        label = new


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.select("vec_id", "n_links", "component_id").collect()}


def recall(got, want):
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    return sum(got[i][0] for i in want) / sum(w[0] for w in want.values()), np.mean([got[i][1] == want[i][1] for i in want if want[i][0]])


def groups(rng, n, crowd, pairs, d=64):
    """n vectors: a crowd of near copies, chains, pairs, exact copies, and the rest apart."""
    x = rng.standard_normal((n, d))
    x[:crowd] = x[0] + 0.25 * rng.standard_normal((crowd, d))
    for i in range(crowd, crowd + 2 * pairs, 2):
        x[i + 1] = x[i] + 0.3 * rng.standard_normal(d)
    x[-40:] = x[-41] * 1.0
    return [(3 * int(i), v.tolist()) for i, v in zip(rng.permutation(n), x.astype(np.float32))]


def test_one_shard_and_cut_shards(spark):
    rows = groups(np.random.default_rng(1), 3000, 300, 300)
    want = brute(rows)
    whole = recall(result(flatgraph.near_duplicates(frame(spark, rows))), want)
    cut = recall(result(flatgraph.near_duplicates(frame(spark, rows), most=600, target=200)), want)
    assert min(whole) >= 0.99 and min(cut) >= 0.95


def test_a_crowd_beyond_a_shard_keeps_all_its_pairs(spark):
    """All but a few vectors are near copies of one: blocks by hash, every two together."""
    rows = groups(np.random.default_rng(2), 900, 800, 10)
    assert min(recall(result(flatgraph.near_duplicates(frame(spark, rows), most=200, target=100)), brute(rows))) >= 0.99


def test_rows_that_link_with_nothing(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(5, e), (3, [2.0, 0.0, 0.0]), (9, e), (None, e), (1, None), (2, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (10, [1.0, 0.0]), (11, [1e200, 1e190, 0.0]), (12, [0.0, 1.0, 0.0])]
    got = flatgraph.near_duplicates(frame(spark, rows, "double")).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows)
    assert by == {5: (4, 3, False), 3: (4, 3, True), 9: (4, 3, False), None: (4, 3, False), 11: (4, 3, False), 12: (0, 12, True), **{i: (0, i, True) for i in (1, 2, 4, 6, 7, 8, 10)}}
    assert flatgraph.near_duplicates(frame(spark, [])).count() == 0


def test_tables(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert result(flatgraph.near_duplicates(given)) == brute([(r["vec_id"], r["embedding"]) for r in given.collect()])


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_graph_reaches_every_row(n):
    x = np.random.default_rng(n).standard_normal((n, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = flatgraph.build_graph(x)
    assert graph.max(initial=-1) < n and (graph != np.arange(n)[:, None]).all()
    reached, edge = {flatgraph.medoid(x)}, [flatgraph.medoid(x)]
    while edge:
        edge = [int(j) for i in edge for j in graph[i] if j >= 0 and int(j) not in reached and not reached.add(int(j))]
    assert len(reached) == n
