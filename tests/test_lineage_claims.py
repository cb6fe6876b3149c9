import random

import pytest

from siltstone.operators import graph as G


def plain(supports, prints):
    own = [(s, c) for s, c, d in supports if d == "independent" and c is not None and s is not None]
    above = {s: s for s, _ in own}

    def top(x):
        return x if above[x] == x else top(above[x])

    for s, c in own:
        for t, d in own:
            if c == d and {p for x, p in prints if x == s and p is not None} & {p for x, p in prints if x == t}:
                above[top(s)] = top(t)
    return {c: len({top(s) for s, d in own if d == c}) for _, c, _ in supports}


@pytest.mark.parametrize("ids, held", [(400, 1000), (400, 8), (25, 1000)])
def test_roots_of_claims_alone_wide_and_with_supports_in_common(spark, ids, held):
    rng = random.Random(ids + held)
    supports = [(rng.randrange(ids), rng.choice([1, 2, 3, 4, 5, 5, 5, None]), rng.choice(["independent", "independent", "dependent", "unknown"])) for _ in range(60)]
    prints = [(s, rng.choice([0, 1, 2, 3, 4, 5, 6, 7, None])) for s in {s for s, *_ in supports} for _ in range(rng.randrange(3))]
    got = G.lineage(spark.createDataFrame(supports, "support long, claim long, derived string"), spark.createDataFrame(prints, "support long, print long"), held=held).collect()
    assert {r.claim: r.n_roots for r in got} == plain(supports, prints)
    assert {r.claim for r in got if r.status == "unknown"} == {c for _, c, d in supports if d == "unknown"}


def test_claims_apart_need_no_rounds_over_all_links(spark, monkeypatch):
    monkeypatch.setattr(G, "clusters", lambda *_: pytest.fail("rounds over all links"))
    supports = spark.createDataFrame([(1, 1, "independent"), (2, 1, "independent"), (3, 1, "independent"), (4, 2, "independent")], "support long, claim long, derived string")
    prints = spark.createDataFrame([(1, 7), (2, 7), (4, 7)], "support long, print long")
    assert {r.claim: r.n_roots for r in G.lineage(supports, prints).collect()} == {1: 2, 2: 1}
