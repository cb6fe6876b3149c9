"""Near-duplicates of embeddings by a forest of random-projection trees.

Each tree splits the vectors by random directions, again and again, where few
of them lie; those next to a split go to both sides.  A tree is fitted on the
driver to a sample of bounded size (``SAMPLE`` distinct vectors, chosen by
hash), every vector is then dealt to its leaves, and vectors that share a leaf
are compared, all of them, in double precision.  A leaf whose vectors are close
to each other is not split further, whatever its size: it is compared in tiles,
a task for each pair of tiles.  A pair that meets in several leaves counts in
the first of them, so tasks report sums of links and spanning forests and never
list pairs.  Links found are exact; which pairs meet is a matter of chance, and
tests hold the share found against brute force.

Vectors that are equal are one node with a weight.  Vectors that are null, zero,
or hold null or non-finite components link with nothing.  Only vectors of one
length can be alike: each length has a forest of its own, and the vectors of a
length that at most ``RARE`` have are all compared.  Components are divided by
the largest of them first, so no square over- or underflows.  Rows with a null
id take part: others count them, and their component is the smallest id that
they reach, null if there is none.  Rows may repeat and count as other vectors.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import components, hot_join, local_roots, stored

#: Vectors the forest is fitted to, at most; trees; vectors in a leaf and in a tile, about.
SAMPLE, TREES, LEAF, TILE = 20_000, 12, 400, 1000
#: Vectors of a length that are compared without a forest, at most.
RARE = 1000
#: Nodes none of whose rows has an id are numbered from here.
NO_ID = 1 << 62
#: Share of a node's vectors on either side of a split that go to both.
SPILL = 0.05
#: Squared length of the mean of unit vectors from which a node is not split.
TIGHT = 0.8


class Forest:
    """For each tree its directions (one a level) and, by level and node, the
    thresholds ``low`` and ``high``: a vector goes right from low on and left up to
    high.  Nodes without thresholds are leaves; ``tiles`` says into how many tiles
    they are dealt."""

    def __init__(self, sample: np.ndarray, count: int, trees: int = TREES, leaf: int = LEAF, tile: int = TILE, spill: float = SPILL, seed: int = 7):
        self.trees = []
        least = max(12.0, leaf * len(sample) / max(1, count))
        scale = count / max(1, len(sample))
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            directions, levels, tiles = [], [], {}
            nodes = {0: np.arange(len(sample))}
            for level in range(40):
                d = rng.standard_normal(sample.shape[1])
                along, low, high, below = sample @ d, {}, {}, {}
                for node, who in nodes.items():
                    mean = sample[who].mean(0) if len(who) else 0.0
                    cut = None if len(who) <= least or float(np.dot(mean, mean)) >= TIGHT else self._cut(np.sort(along[who]), spill)
                    if cut is None:
                        tiles[level, node] = max(1, math.ceil(1.2 * len(who) * scale / tile))
                        continue
                    low[node], high[node] = cut
                    below[2 * node], below[2 * node + 1] = who[along[who] <= cut[1]], who[along[who] >= cut[0]]
                if not below:
                    break
                directions.append(d)
                levels.append((low, high))
                nodes = below
            self.trees.append((np.array(directions).reshape(-1, sample.shape[1]), levels, tiles))

    @staticmethod
    def _cut(x: np.ndarray, spill: float):
        """Thresholds around the emptiest place of the sorted projections that is not far out."""
        n = len(x)
        half = max(1, int(n * spill))
        ranks = np.arange(max(half, int(0.25 * n)), min(n - half - 1, int(0.75 * n)) + 1)
        if not len(ranks):
            return None
        best = ranks[np.argmax(x[ranks + half] - x[ranks - half] - 1e-3 * np.abs(ranks - n / 2) / n)]
        low, high = x[best - half], x[best + half]
        return (float(low), float(high)) if low > x[0] and high < x[-1] else None

    def leaves(self, x: np.ndarray):
        """(row, tree, leaf number, tiles) arrays; a leaf's number tells its tree, level and node."""
        out = []
        for t, (directions, levels, tiles) in enumerate(self.trees):
            along = x @ directions.T if len(directions) else np.zeros((len(x), 0))
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(len(levels) + 1):
                at_leaf = np.ones(len(row), bool)
                nxt_row, nxt_node = [], []
                if level < len(levels):
                    low, high = levels[level]
                    kinds, back = np.unique(node, return_inverse=True)
                    lo = np.array([low.get(k, np.nan) for k in kinds.tolist()])[back]
                    hi = np.array([high.get(k, np.nan) for k in kinds.tolist()])[back]
                    at_leaf = np.isnan(lo)
                    value = along[row, level]
                    left, right = ~at_leaf & (value <= hi), ~at_leaf & (value >= lo)
                    nxt_row, nxt_node = [row[left], row[right]], [2 * node[left], 2 * node[right] + 1]
                if at_leaf.any():
                    who, where = row[at_leaf], node[at_leaf]
                    kinds, back = np.unique(where, return_inverse=True)
                    k = np.array([tiles.get((level, n), 1) for n in kinds.tolist()])[back]
                    out.append((who, np.full(len(who), t), (np.int64(t) << 48) | (np.int64(level) << 42) | where, k))
                if not nxt_row:
                    break
                row, node = np.concatenate(nxt_row), np.concatenate(nxt_node)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _met_before(mine: np.ndarray, other: np.ndarray, leaf: int) -> np.ndarray:
    """Whether rows of two arrays of leaf numbers (-1: none) share one below ``leaf``."""
    out = np.zeros(len(mine), bool)
    open_ = np.arange(len(mine))
    for k in range(mine.shape[1]):
        x = mine[open_, k]
        same = (x >= 0) & (x < leaf) & (other[open_] == x[:, None]).any(1)
        out[open_[same]] = True
        open_ = open_[~same]
        if not len(open_):
            break
    return out


def unit(rows: list) -> np.ndarray:
    """Rows of one length, each divided by its own."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(nodes: DataFrame, threshold: float, sample: int = SAMPLE, rare: int = RARE, **shape) -> DataFrame:
    """(node, n, root): for each task and node the weight of the nodes newly linked
    to it, and a node it is connected with.  ``nodes``: node, vector, weight; unit
    length is not asked for."""
    counts = {r["d"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    forests = {}
    for d, n in counts.items():
        chosen = []
        if n > rare:
            share = max(1, sample * n // sum(counts.values()))  # ``sample`` rows for all lengths together, about
            chosen = nodes.where(F.size("vector") == d).orderBy(F.xxhash64("node"), "node").limit(share).select("vector").collect()
        forests[d] = Forest(unit([r["vector"] for r in chosen]) if chosen else np.zeros((0, d)), n, **(shape if chosen else shape | {"trees": 1}))
    known = nodes.sparkSession.sparkContext.broadcast(forests)

    def dealt_rows(forest, d, x, part):
        node, weight = part.column(0).to_numpy(), part.column(2).to_numpy()
        row, _, leaf, tiles = forest.leaves(x)
        order = np.lexsort((leaf, row))
        row, leaf, tiles = row[order], leaf[order], tiles[order]
        every = np.split(leaf, np.flatnonzero(np.diff(row)) + 1)
        packed, vectors = [e.tobytes() for e in every], [v.tobytes() for v in x]
        own = (node[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles
        r = np.repeat(np.arange(len(row)), tiles)
        other = np.arange(len(r)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        a, b = np.minimum(own[r], other), np.maximum(own[r], other)
        columns = [np.full(len(r), d), leaf[r], a, b, own[r], node[row[r]], weight[row[r]]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([packed[i] for i in row[r]], pa.binary()), pa.array([vectors[i] for i in row[r]], pa.binary())], names=["d", "leaf", "a", "b", "own", "node", "weight", "leaves", "vector"])

    def deal(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                vectors, size = part.column(1).to_pylist(), part.column(1).value_lengths().to_numpy()
                for d in np.unique(size).tolist():
                    who = np.flatnonzero(size == d)
                    yield dealt_rows(known.value[d], d, unit([vectors[i] for i in who]), part.take(pa.array(who)))

    dealt = nodes.select("node", "vector", "weight").mapInArrow(deal, "d long, leaf long, a long, b long, own long, node long, weight long, leaves binary, vector binary")

    def compare(key, frame):
        _, leaf, a, b = (int(k) for k in key)
        own = frame["own"].to_numpy()
        order = np.concatenate((np.flatnonzero(own == a), np.flatnonzero(own != a)))
        frame, n = frame.iloc[order], int((own == a).sum())
        x = np.array([np.frombuffer(v) for v in frame["vector"]])
        lists = [np.frombuffer(v, np.int64) for v in frame["leaves"]]
        member = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for i, v in enumerate(lists):
            member[i, : len(v)] = v
        node, weight = frame["node"].to_numpy(), frame["weight"].to_numpy()
        linked = np.zeros(len(x), np.int64)

        def pairs():
            start = 0 if a == b else n
            for at in range(0, n, 250):
                i, j = np.nonzero(x[at : min(at + 250, n)] @ x[start:].T >= threshold)
                i, j = i + at, j + start
                if a == b:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 100_000):
                    p, q = i[k : k + 100_000], j[k : k + 100_000]
                    new = ~_met_before(member[p], member[q], leaf)
                    p, q = p[new], q[new]
                    np.add.at(linked, p, weight[q])
                    np.add.at(linked, q, weight[p])
                    yield p, q

        root = local_roots(len(x), pairs())
        some = np.flatnonzero(linked)
        return pd.DataFrame({"node": node[some], "n": linked[some], "root": node[root[some]]})

    return dealt.groupBy("d", "leaf", "a", "b").applyInPandas(compare, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **shape) -> DataFrame:
    """id, n_links, component_id, kept for each row."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(finite, F.lit(False)))
    keyed = rows.withColumn("key", F.when(F.col("ok"), F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))))
    number = F.coalesce(F.min("vec_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("key"), 3))
    nodes = stored(keyed.where("ok").groupBy("key").agg(number.alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("vector").alias("vector")), "vectors")
    found = stored(links(nodes, threshold, **shape), "links")
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    label = nodes.select("key", "node", "weight").join(sums, "node", "left").join(groups, "node", "left")
    label = stored(label.select("key", F.col("weight").alias("w"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c")).withColumn("component_id", F.when(F.col("c") < NO_ID, F.col("c"))).drop("c"), "labels")
    small = keyed.where("ok").select("vec_id", "key")
    linked = hot_join(small, label, "key", "w", nodes.agg(F.coalesce(F.sum("weight"), F.lit(1))).first()[0]).drop("key")
    alone = keyed.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
