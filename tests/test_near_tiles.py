"""Pairs of alike token sets where sets are dealt into many tiles and cells, and what is compared for them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import search as Q


def near_copies(r: random.Random, words: list[str], n: int) -> list[str]:
    return [" ".join(r.sample(words, len(words) - r.randrange(4)) + [f"own{r.randrange(10**9)}"]) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_all_pairs_of_many_tiles_are_found(spark, monkeypatch, threshold):
    for name, value in (("TILE", (1, 600)), ("CELL", 7), ("MATCHES", 50), ("TOKENS", 100)):
        monkeypatch.setattr(Q, name, value)
    r = random.Random(11)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 500}" for _ in range(r.choice([1, 2, 4, 9, 30, 70]))) for _ in range(60)]
    texts += [t for size in (6, 20, 60) for t in near_copies(r, [f"v{size}x{i}" for i in range(size)], 25)]
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts)] + [("k000", texts[70] + " more")]  # a key with two texts
    names = {}
    for k, t in rows:
        names[frozenset(t.split())] = min(k, names.get(frozenset(t.split()), k))
    wanted = sorted((*sorted((k, j)), round(len(x & y) / len(x | y), 9)) for (x, k), (y, j) in itertools.combinations(names.items(), 2) if k != j and len(x & y) / len(x | y) >= threshold)
    pairs, _ = Q.near_claims(spark.createDataFrame(rows, "id string, body string"), "id", "body", threshold)
    assert sorted((p["left_id"], p["right_id"], round(p["similarity"], 9)) for p in pairs.collect()) == wanted and len(wanted) > 500


def test_a_set_goes_to_few_cells(spark):
    """Of a group of near copies each set is sent once, not with each of its pairs."""
    group = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "left_id long, right_id long")
    cells = Q._by_cell(group)
    assert cells.count() == 40 and cells.agg(F.sum(F.size("others"))).first()[0] == 780


def test_long_sets_that_share_by_chance_are_not_compared(spark, monkeypatch):
    r = random.Random(7)
    texts = [" ".join(f"w{i}" for i in r.sample(range(12000), 1200)) for _ in range(40)]
    texts += [f"{t} more" for t in texts[:5]]
    met, written = {}, Q.written

    def kept(rows, name):
        out = written(rows, name)
        met[name] = out.count()
        return out

    monkeypatch.setattr(Q, "written", kept)
    pairs, _ = Q.near_claims(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "id", "body", 0.7)
    assert pairs.count() == 5 and met["claim-pairs"] < 200  # of 990, all of which share four of their rarest


@pytest.mark.parametrize("threshold", [0.2, 0.7])
def test_parities_rule_out_no_alike_pair(threshold):
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 20, 63, 64, 65, 130, 500, 1300):
        base = r.integers(-(2**63), 2**63 - 1, n)
        for share in (1.0, 0.95, 0.8, 0.5, 0.25):
            own = r.integers(-(2**63), 2**63 - 1, int(n * (1 - share)) * 2)
            sets += [np.concatenate((base[: max(1, int(n * share))], own[: len(own) // 2])), np.concatenate((base, own))]
    size = np.array([len(x) for x in sets])
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(sets)), 2), strict=True))
    likeness = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    may = Q._alike(size, Q._parities(size, np.concatenate(sets)), i, j, threshold)
    assert may[likeness >= threshold].all() and (likeness >= threshold).sum() > 20
    far = (likeness < 0.4) & (np.minimum(size[i], size[j]) >= np.maximum(100, 0.7 * np.maximum(size[i], size[j])))
    assert threshold < 0.7 or (far.any() and not may[far].any())
