"""Pairs of alike token sets against a comparison of all pairs, and how many pairs are compared for them."""

import itertools
import random

import pytest

from siltstone.operators import search as Q


def claims(seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.4)) % 3000}"
    texts = [[word() for _ in range(r.choice([1, 2, 3, 5, 8, 13, 40, 90]))] for _ in range(120)]
    for words in r.sample(texts, 80):  # near copies: words left out, put in or exchanged
        own = [w for w in words if r.random() > 0.1] + [word() for _ in range(r.randrange(1 + len(words) // 6))]
        texts.append(own or words)
    return [(k, " ".join(t)) for k, t in enumerate([*texts, *texts[:20], []])] + [(1, "w1 w2 w3 w4 w5 w6"), (None, "w1 w2 w3 w4 w5 w6 w7")]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.82, 1.0])
def test_all_pairs_are_found(spark, threshold):
    rows = claims(3)
    names = {}
    for k, text in rows:
        t = frozenset(text.split())
        names[t] = min((x for x in (k, names.get(t)) if x is not None), default=None)
    named = [(k, t) for t, k in names.items() if t and k is not None]
    wanted = []
    for (k, x), (j, y) in itertools.combinations(named, 2):
        if k != j and len(x & y) / len(x | y) >= threshold:
            wanted.append((min(k, j), max(k, j), round(len(x & y) / len(x | y), 9)))
    pairs, members = Q.near_claims(spark.createDataFrame(rows, "id long, body string"), "id", "body", threshold)
    found = sorted((r["left_id"], r["right_id"], round(r["similarity"], 9)) for r in pairs.collect())
    assert found == sorted(wanted) and (wanted or threshold == 1.0)
    assert members.count() == len(rows)


def test_few_pairs_are_compared(spark, monkeypatch):
    """Sets of common words meet in one or two of their rarest by chance; only those that share more are compared."""
    r = random.Random(5)
    texts = [" ".join(r.sample([f"w{i}" for i in range(400)], 60)) for _ in range(200)]
    texts += [f"{t} more" for t in texts[:5]]
    met, written = [], Q.written

    def kept(rows, name):
        out = written(rows, name)
        met.append((name, out.count()))
        return out

    monkeypatch.setattr(Q, "written", kept)
    pairs, _ = Q.near_claims(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "id", "body", 0.7)
    assert pairs.count() == 5 and dict(met)["claim-pairs"] < 2000  # of 20 910
