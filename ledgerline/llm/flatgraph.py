"""Near-duplicate embeddings by robust-pruned flat graphs on overlapping cluster shards.

1. Equal vectors become one, with the number of its copies.
2. Shards: a cell with over MOST vectors gets centroids from a bounded sample of its own (at most about SAMPLE rows; the
   only thing that a sample is used for), and every vector goes to its `overlap` nearest ones; again until no cell is
   too large. A cell whose sample is mostly linked to itself can't be told apart by centroids: its vectors are
   dealt to blocks by a hash, and every two blocks make a shard, so that all of its pairs stay together somewhere.
3. Each shard builds a graph by inserting batches of doubling size: a greedy beam search gives candidates, robust pruning
   keeps near ones of different directions, and edges back are pruned in the same way.
4. The adjacency lists of a vector's shards are united: one flat graph.
5. Search: from the shard's medoid and the vector itself, a greedy beam runs on the flat graph; then the range expands: all
   that is in range is expanded in turn, however much it is. What is found is verified in double precision, and
   counts for both ends.
6. Audit: a sample of vectors by hash (at most AUDIT) is compared with all vectors by brute force. Where less than
   RECALL of their links were found, the shards are cut again with more overlap.

A link found is never emitted as a row: of the shards that hold both ends, the first by name counts it, and a shard gives
one row for each linked vector, with its count and the smallest vector that it hangs together with there. So rows
grow with the vectors, not with the pairs of a group, and a hot group of vectors costs tasks, not one task's memory.

Vectors that are null, empty, zero, or hold null or non-finite entries link with nothing: no links, alone, kept.
Vectors of different lengths don't link. Repeated ids are rows of their own. A null id counts as a link and is never the
smallest id; where a component has no other, component_id is null and kept false. An empty table gives an empty result.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .common import discard, written

LEAST = 0.9
#: Vectors of a shard: at most, and on average after a cut. Centroids of a cut, and sampled rows for them.
MOST, TARGET, BRANCHES, SAMPLE = 4096, 1024, 64, 8192
#: Share of a cell's sampled pairs that are linked from which on it is cut into blocks by a hash.
DENSE = 0.25
#: Shards that a vector goes to at each cut, at first and at most.
OVERLAP, MOST_OVERLAP = 2, 5
#: Out-degree, candidates, slack of pruning (on distances), beam, nodes expanded at once, batch of insertions.
DEGREE, CANDIDATES, ALPHA, BEAM, AT_ONCE, BATCH = 24, 96, 1.2, 32, 4, 512
#: How far below the range nodes are expanded still, and how many at once.
MARGIN, EDGE = 0.03, 1 << 15
#: Vectors that are compared with all others, and the share of their links that must have been found.
AUDIT, RECALL = 512, 0.97
#: What single precision may get wrong in a cosine.
SLACK = 1e-4


def linkable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda c: c != 0)


def _units(vectors: pd.Series, kind=np.float64) -> np.ndarray:
    """Rows of length one; scaled by the largest entry first, so that no square overflows."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(kind)


# --- shards


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means from far-apart seeds; centroids within reach of an earlier one go, as they would cut a group of near copies."""
    far = np.full(len(x), np.inf)
    picked = [int(rng.integers(len(x)))]
    while len(picked) < min(k, len(x)):
        far = np.minimum(far, np.maximum(0, 1 - x @ x[picked[-1]]))
        if far.sum() <= 0:
            break
        picked.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[picked]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    apart = []
    for i in range(len(c)):
        if not apart or (c[apart] @ c[i]).max() < LEAST:
            apart.append(i)
    return c[apart]


def _fitted(target: int, overlap: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """A cell's centroids; none where it is dense or centroids don't part it."""
        x, n = _units(rows["v"]), int(rows["n"].iloc[0])
        some = x[: 2 * AUDIT]
        linked = ((some @ some.T >= LEAST).sum() - len(some)) / max(1, len(some) * (len(some) - 1))
        k = min(BRANCHES, max(4 * overlap, -(-n // target)))
        c = _centroids(x, k, np.random.default_rng(n)) if linked < DENSE and not rows["stuck"].iloc[0] else []
        return pd.DataFrame({"cell": rows["cell"].iloc[:1], "centroids": [[list(map(float, v)) for v in c] if len(c) > overlap else None]})

    return fit


def _cut(members: DataFrame, counts: DataFrame, overlap: int, depth: int, most: int, target: int) -> DataFrame:
    """Members of cells that are too large, in smaller ones: (uid, v, cell, from). Routed in chunks of bounded size."""
    rows = members.select("uid", "v", "cell").join(counts, "cell")
    lot = F.pmod(F.xxhash64("uid", F.lit(depth)), F.lit(1 << 30)) / float(1 << 30)
    fits = rows.filter(lot < SAMPLE / F.col("n")).groupBy("cell").applyInPandas(_fitted(target, overlap), "cell string, centroids array<array<double>>")
    fits = written(counts.join(fits, "cell", "left"), "centroids")
    near = fits.filter("centroids is not null").select("cell", "n", "centroids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / most))).alias("chunk"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.floor(F.col("n") / most) + 1))
    out = "uid long, v array<double>, cell string, from long"

    def route(some: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if some.empty or fit.empty:
            return pd.DataFrame({c: pd.Series([], dtype=kind) for c, kind in (("uid", "int64"), ("v", object), ("cell", object), ("from", "int64"))})
        c = np.array([np.asarray(v) for v in fit["centroids"].iloc[0]])
        m = min(overlap, len(c))
        s = _units(some["v"]) @ c.T
        best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(m), (len(s), 1))
        at, name = np.repeat(np.arange(len(some)), m), some["cell"].iloc[0]
        return pd.DataFrame({"uid": some["uid"].to_numpy()[at], "v": some["v"].to_numpy()[at], "cell": [f"{name}/{j:02d}" for j in best.ravel()], "from": int(fit["n"].iloc[0])})

    split = rows.select("cell", "chunk", "uid", "v").groupBy("cell", "chunk").cogroup(near.groupBy("cell", "chunk")).applyInPandas(route, out)
    blocks = F.floor(2 * F.col("n") / most) + 1
    dense = rows.join(fits.filter("centroids is null").select("cell"), "cell").select("uid", "v", "cell", blocks.alias("b"), F.pmod(F.xxhash64("uid", F.lit(-1)), blocks).alias("own"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("b") - 1), lambda j: j != F.col("own"))
    dense = dense.select("uid", "v", "cell", "own", F.explode(others).alias("other"))
    pair = F.concat("cell", F.lit("+"), F.least("own", "other"), F.lit("-"), F.greatest("own", "other"))
    return split.unionByName(dense.select("uid", "v", pair.alias("cell"), F.lit(0).cast("long").alias("from")))


def shards(vectors: DataFrame, overlap: int = OVERLAP, most: int = MOST, target: int = TARGET) -> DataFrame:
    """(uid, v, cell): every vector in the cells of its nearest centroids, none of much over `most` vectors.

    A cell that kept over three quarters of the one it came from is stuck, and is cut into blocks by a hash.
    """
    rest, done, depth = vectors.select("uid", "v", F.concat(F.lit("d"), F.size("v").cast("string")).alias("cell"), F.lit(None).cast("long").alias("from")), None, 0
    while True:
        sizes = rest.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("from").alias("from"))
        stuck = F.coalesce(F.col("n") > 0.75 * F.col("from"), F.lit(False))
        counts = written(sizes.select("cell", "n", stuck.alias("stuck"), ((F.col("n") > most) & ~F.contains("cell", F.lit("+"))).alias("large")), "cell-sizes")
        small = rest.join(counts.filter("not large").select("cell"), "cell").select("uid", "v", "cell")
        done = small if done is None else done.unionByName(small)
        large = counts.filter("large").drop("large")
        if large.isEmpty():
            return done
        rest = written(_cut(rest, large, overlap, depth, most, target), "cells")
        depth += 1


# --- graphs, in tasks


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, similarities) of every query's beam, best first, and the nodes expanded on the way; -1 where there is none.

    graph: neighbours of every node, -1 for none; starts: nodes to begin from, -1 for none. All queries go side by side.
    """
    b, n = len(queries), len(x)
    ids, sims = np.full((b, width), -1), np.full((b, width), -np.inf, dtype=x.dtype)
    done, seen, path = np.zeros((b, width), bool), np.zeros((b, n + 1), bool), []
    seen[:, n] = True  # -1 is the last column

    def take(rows: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[rows[:, None], new]] = -1
        seen[rows[:, None], new] = True
        s = np.einsum("bd,brd->br", queries[rows], x[new])
        s[new < 0] = -np.inf
        all_ids, all_sims = np.concatenate([ids[rows], new], 1), np.concatenate([sims[rows], s], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        flags = np.concatenate([done[rows], np.zeros(new.shape, bool)], 1)
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sims, flags))

    take(np.arange(b), starts.copy())
    ids[np.isneginf(sims)] = -1
    while True:
        open_ = ~done & (ids >= 0)
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return ids, sims, np.concatenate(path, 1) if path else np.full((b, 0), -1)
        first = np.argsort(~open_[rows], axis=1, kind="stable")[:, :AT_ONCE]  # beams are sorted: the nearest open ones
        valid = np.take_along_axis(open_[rows], first, 1)
        nodes = np.where(valid, np.take_along_axis(ids[rows], first, 1), -1)
        done[rows[:, None], first] = True
        step = np.full((b, first.shape[1]), -1)
        step[rows] = nodes
        path.append(step)
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1)
        take(rows, near.reshape(len(rows), -1))
        ids[np.isneginf(sims)] = -1


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Every node's neighbours from its candidates (-1: none): the nearest, then the nearest that no chosen one is much nearer to."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == nodes[:, None]] = -1
    s = np.einsum("bd,bcd->bc", x[nodes], x[c])
    s[c < 0] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")[:, :CANDIDATES]
    c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
    among = np.matmul(x[c], x[c].transpose(0, 2, 1))
    own = np.where(c >= 0, 2 - 2 * np.where(c >= 0, s, 0), 0)
    alive, out, rows = c >= 0, np.full((len(nodes), degree), -1), np.arange(len(nodes))
    for r in range(degree):
        pick = alive.argmax(1)
        good = alive[rows, pick]
        if not good.any():
            break
        out[good, r] = c[rows, pick][good]
        nearer = ALPHA**2 * (2 - 2 * among[rows, pick]) <= own
        alive &= ~(nearer & good[:, None])
        alive[rows, pick] = False
    return out


def _link_back(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray) -> None:
    """Edges back from the neighbours of nodes; a neighbour without room prunes."""
    q, p = graph[nodes].ravel(), np.repeat(nodes, graph.shape[1])
    p, q = p[q >= 0], q[q >= 0]
    near = np.einsum("pd,pd->p", x[p], x[q])
    order = np.lexsort((-near, q))
    p, q = p[order], q[order]
    who, first = np.unique(q, return_index=True)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    p, q, place = p[place < CANDIDATES - DEGREE], q[place < CANDIDATES - DEGREE], place[place < CANDIDATES - DEGREE]
    new = np.full((len(who), CANDIDATES - DEGREE), -1)
    new[np.searchsorted(who, q), place] = p
    for at in range(0, len(who), BATCH):
        some = who[at : at + BATCH]
        both = np.concatenate([graph[some], new[at : at + BATCH]], 1)
        both = np.sort(both, axis=1)[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = np.sort(both, axis=1)[:, ::-1]
        fits = both[:, DEGREE] < 0
        graph[some[fits]] = both[fits, :DEGREE]
        if not fits.all():
            graph[some[~fits]] = robust_prune(x, some[~fits], both[~fits].copy())


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbours of every row of x, by batches of doubling size; a batch's rows are candidates of each other as well."""
    n, first = len(x), medoid(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[first], order[order != first]])
    graph, at = np.full((n, DEGREE), -1), 1
    while at < n:
        batch = order[at : at + min(at, BATCH)]
        ids, _, path = beam_search(x, graph, x[batch], np.full((len(batch), 1), first), BEAM)
        peers = x[batch] @ x[batch].T
        np.fill_diagonal(peers, -np.inf)
        m = min(DEGREE, len(batch))
        near = batch[np.argpartition(-peers, m - 1, axis=1)[:, :m]]
        graph[batch] = robust_prune(x, batch, np.concatenate([ids, path, near], 1))
        _link_back(x, graph, batch)
        at += len(batch)
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, least: float) -> np.ndarray:
    """n x n booleans: which rows of x the search from the medoid and the row itself finds at `least` or more, before verifying.

    A beam comes near; from then on the range expands: what is in range or a little below is expanded until all that it leads to is further away.
    """
    n, start = len(x), medoid(x)
    found = np.zeros((n, n), bool)
    for at in range(0, n, BATCH):
        q = np.arange(at, min(n, at + BATCH))
        ids, sims, _ = beam_search(x, graph, x[q], np.stack([np.full(len(q), start), q], 1), min(BEAM, n))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        seen[np.arange(len(q))[:, None], ids] = True
        row, place = np.nonzero(sims >= least - MARGIN)
        edge = [(row, ids[row, place], sims[row, place])]
        while edge:
            row, node, sim = edge.pop()
            found[q[row[sim >= least]], node[sim >= least]] = True
            if len(row) > EDGE:
                edge.append((row[EDGE:], node[EDGE:], sim[EDGE:]))
                row, node = row[:EDGE], node[:EDGE]
            near = graph[node]
            row, near = np.repeat(row, near.shape[1]), near.ravel()
            new = ~seen[row, near]
            key = np.unique(row[new] * (n + 1) + near[new])
            row, near = key // (n + 1), key % (n + 1)
            seen[row, near] = True
            sim = np.einsum("pd,pd->p", x[q[row]], x[near])
            inside = sim >= least - MARGIN
            if inside.any():
                edge.append((row[inside], near[inside], sim[inside]))
    np.fill_diagonal(found, False)
    return found


def verified(x: np.ndarray, found: np.ndarray, least: float) -> np.ndarray:
    """Both directions of what was found, where the cosine in double precision is `least` or more."""
    found |= found.T
    i, j = np.nonzero(np.triu(found))
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        no = np.einsum("pd,pd->p", x[a], x[b]) < least
        found[a[no], b[no]] = found[b[no], a[no]] = False
    return found


def roots_within(links: np.ndarray) -> np.ndarray:
    """The first row that each row hangs together with."""
    label = np.arange(len(links))
    i, j = np.nonzero(links)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


# --- the job


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("uid")
    uid, x = rows["uid"].to_numpy(), _units(rows["v"], np.float32)
    near = [uid[g[g >= 0]].tolist() for g in build_graph(x)]
    return pd.DataFrame({"uid": uid, "cell": rows["cell"].to_numpy(), "near": near})


def _searched(least: float):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        uid, x = rows["uid"].to_numpy(), _units(rows["v"])
        lists = [np.asarray(v, dtype=np.int64) for v in rows["near"]]
        graph = np.full((len(uid), max(1, max(map(len, lists)))), -1)
        for i, near in enumerate(lists):
            at = np.minimum(np.searchsorted(uid, near), len(uid) - 1)
            at = at[uid[at] == near]  # of the united lists, those within the shard
            graph[i, : len(at)] = at
        links = verified(x, range_search(x.astype(np.float32), graph, least - SLACK), least)
        some = np.flatnonzero(links.any(1))
        links = links[np.ix_(some, some)]
        low = some[roots_within(links)]
        # of the shards that hold both ends, the first by name counts a link
        names = rows["cells"].iloc[some].tolist()
        known = {c: k for k, c in enumerate(sorted({c for cells in names for c in cells}))}
        here, copies = known.get(rows["cell"].iloc[0], -1), rows["copies"].to_numpy()[some]
        before = np.zeros((len(some), max(1, here)), bool)
        for i, cells in enumerate(names):
            earlier = [known[c] for c in cells if known[c] < here]
            before[i, earlier] = True
        counted = np.array([int(copies[row & ~(before[:, before[i]].any(1))].sum()) for i, row in enumerate(links)], dtype=np.int64)
        return pd.DataFrame({"uid": uid[some], "links": counted, "low": uid[low]})

    return search


def linked(vectors: DataFrame, least: float, overlap: int, most: int = MOST, target: int = TARGET) -> DataFrame:
    """(uid, links, low) of every linked vector and shard, from (uid, v, copies): counted links, and the first vector that it hangs together with there."""
    members = written(shards(vectors, overlap, most, target), "shards")
    graph = members.groupBy("cell").applyInPandas(_built, "uid long, cell string, near array<long>")
    flat = graph.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("cell").alias("cells"))
    flat = written(flat.join(vectors.select("uid", "copies"), "uid"), "flat-graph")
    found = members.join(flat, "uid").groupBy("cell").applyInPandas(_searched(least), "uid long, links long, low long")
    found = written(found, "links")
    discard(members)
    discard(flat)
    return found


def audited(vectors: DataFrame, found: DataFrame, least: float, sample: int = AUDIT) -> float:
    """Share of the links of sampled vectors that were found; the sample is bounded, what it is compared with is everything."""
    rows = vectors.orderBy(F.xxhash64("uid", F.lit("audit"))).limit(sample).select("uid", "v").collect()
    if not rows:
        return 1.0
    groups = {d: ([r["uid"] for r in rows if len(r["v"]) == d], _units(pd.Series([r["v"] for r in rows if len(r["v"]) == d]))) for d in {len(r["v"]) for r in rows}}

    def compare(batches):
        for b in batches:
            for d, part in b.groupby(b["v"].map(len)):
                if d in groups:
                    uids, q = groups[d]
                    hit = _units(part["v"]) @ q.T >= least
                    n = (hit * part["copies"].to_numpy()[:, None]).sum(0) - (part["uid"].to_numpy()[:, None] == np.array(uids)).T @ part["copies"].to_numpy()
                    yield pd.DataFrame({"uid": uids, "n": n})

    true = vectors.select("uid", "v", "copies").mapInPandas(compare, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n"))
    mine = found.groupBy("uid").agg(F.sum("links").alias("links"))
    row = true.join(mine, "uid", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0)))), F.avg(F.when(F.col("n") > 0, F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))))).first()
    return min(row[1] / row[0], row[2]) if row[0] else 1.0


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, most: int = MOST, target: int = TARGET) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), F.when(linkable(v), v).alias("v"))
    reps = rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first"))
    reps = written(reps.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    for overlap in range(OVERLAP, MOST_OVERLAP + 1):
        found = linked(reps, least, overlap, most, target)
        if audited(reps, found, least) >= RECALL:
            break
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("uid <> low").select("uid", "low"))
    of = reps.select("uid", "v", "first", "copies").join(counts, "uid", "left").join(groups.withColumnRenamed("node", "uid"), "uid", "left")
    of = written(of.withColumn("root", F.coalesce("root", "uid")), "linked-vectors")
    least_id = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(of.join(least_id, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "classes")
    out = rows.filter("v is not null").join(of, "v").select("key", "n_links", "component_id")
    alone = rows.filter("v is null").select("key", F.lit(0).cast("long"), F.col("key"))
    out = out.union(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
