"""Exact duplicates, ranked search and whitening against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import exact, ranked, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_duplicates(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [f"text {rng.random()}" for _ in range(150)] + ["", None, " ", "É", "é" * 200_000]
    out = [(i, texts[i % len(texts)]) for i in range(230)] + [(i, "the same for a third") for i in range(230, 340)]
    return [*out, (340, "twice"), (340, "twice"), (None, "no id"), (None, "no id"), (None, texts[0]), (341, None), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [F.lit(7).alias(c) for c in ("key", "row", "sha", "w", "bucket", "owner", "slot", "keep_id", "item", "n", "term", "score", "rank")]
    return spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS).select("*", *clash).repartition(6)


@pytest.mark.parametrize("bits, capacity", [(64, None), (64, 2), (5, 3), (1, 1)])
def test_exact(docs, rows, bits, capacity):
    """At few bits nearly every key is a chain of several texts, and at a small capacity the directory doubles often."""
    got = exact.duplicates(docs, capacity=capacity, bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in got), key=str) == plain_duplicates(rows)
    kept = Counter(bytes(r.sha) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert any(r.collided for r in got) == (bits < 64)


def test_exact_of_no_rows(spark):
    assert exact.duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r)[:4] for r in exact.duplicates(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, None, 1, True)]


def test_directory_splits_full_buckets_alone(spark):
    rng = random.Random(1)
    values = {rng.getrandbits(64) >> rng.choice([0, 0, 0, 7]) for _ in range(900)}
    keys = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "key long")
    buckets = exact.directory(keys, 10)
    held = lambda d, p: sum(v >> (64 - d) == p if d else True for v in values)
    assert sum(1 << (64 - d) for d, _ in buckets) == 1 << 64
    assert all(held(d, p) <= 10 for d, p in buckets) and all(held(d - 1, p >> 1) > 10 for d, p in buckets)
    assert [p << (64 - d) for d, p in buckets] == sorted(p << (64 - d) for d, p in buckets)
    depth, slots = exact.slots_of(spark, buckets, 4)
    rows = slots.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1 << depth)) and [r.owner for r in rows] == sorted(r.owner for r in rows)
    assert exact.directory(keys.where("false"), 10) == [(0, 0)]


def test_index_on_shared_files(spark, docs):
    at = exact.index(exact.entries(docs), capacity=4)
    rows = at.records.withColumn("file", F.input_file_name()).collect()
    assert max(Counter(r.bucket for r in rows).values()) <= 4 and {r.bucket for r in rows} <= set(range(max(r.bucket for r in rows) + 1))
    files = defaultdict(set)
    for r in rows:
        files[r.bucket].add(r.file)
    assert all(len(f) == 1 for f in files.values())
    pruned = at.records.where("bucket = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in pruned


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(rows, items, most):
    said = [(i, WORDS.findall((t or "").translate(LOWER))) for i, t in rows]
    said = [(i, Counter(w), len(w)) for i, w in said if w]
    total, df = sum(n for _, _, n in said), Counter(t for _, c, _ in said for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(WORDS.findall((text or "").translate(LOWER))), []
        for i, counts, n in said:
            m = 100 - 75 + (75 * n * len(said)) // total
            s = sum(k * math.floor(1000 * math.log((2 * len(said) + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t, k in asked.items() if t in counts)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


def test_terms():
    text = "Ab-c_D9 \x00É\x7fİK x y z  É"
    assert [t.decode() for t in ranked.terms(text.encode())] == WORDS.findall(text.translate(LOWER))


@pytest.mark.parametrize("block, window", [(1, 3), (4, 2), (256, 256)])
def test_ranked(spark, block, window):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Été", "x9", "AND"]
    pick = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    rows = [(i, pick(rng.randint(1, 60))) for i in range(180)] + [(i, "w7 w7, same-text\n") for i in range(180, 240)]
    rows += [(None, "w7 w7 w7"), (240, None), (241, ""), (242, " .,- "), (5, rows[5][1]), (243, "w3 " * 40_000)]
    items = [(1, pick(12)), (2, "w7"), (3, "w50 w50 été"), (4, None), (5, "no such, term"), (6, ""), (1, "w9"), (None, "W8 w8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("item"), F.lit(2).alias("score")).repartition(3)
    asks = spark.createDataFrame([*items, items[1]], "item_id long, text string").withColumn("term", F.lit(1))
    got = ranked.search(docs, asks, most=7, block=block, window=window).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_ranks(rows, items, 7)
    none = docs.where("false")
    assert ranked.search(none, asks).collect() == ranked.search(docs, asks.where("false")).collect() == ranked.search(docs, asks.where("item_id = 4")).collect() == []


def test_items_in_groups(spark, monkeypatch):
    rows, items = [(i, f"a{i % 7} b{i % 3} c") for i in range(40)], [(i, f"a{i} c") for i in range(9)]
    monkeypatch.setattr(ranked, "ASKED", 5)
    got = ranked.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_ranks(rows, items, 3)


def test_blocks_are_skipped():
    """Half the blocks can't reach the threshold that the others set, and none of them is scored."""
    asks = ranked.Questions([1], {b"x": 0, b"y": 1}, np.array([0, 2]), np.array([0, 1]), np.array([1, 1]))
    block = lambda at, tf: ranked.Block([at, at + 1], np.array([50, 50]), np.array([0, 1, 2]), np.array([0, 0]), np.array([tf, tf]))
    w = ranked.Weights(20, 1000, np.array([1000, 2000]))
    best = {0: ranked.Best(0, 4)}
    assert ranked.search_window([block(10 * k, 1 if k % 2 else 9) for k in range(8)], asks, w, best) == 4
    assert [d for _, _, d in best[0].rows] == [0, 1, 20, 21]


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    gaps = n * x - s
    value, vector = np.linalg.eigh((gaps / n).T @ (gaps / n) / n)
    value, vector = value[::-1], vector[:, ::-1]
    return [sum(int(g) ** 2 for g in row) for row in gaps], (gaps / n) @ vector[:, :8] / np.sqrt(value[:8]), value[:8] / value.sum()


def test_whitening(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) @ rng.standard_normal((12, 12)) / 5).astype("float32").tolist()
    good += good[:20]
    bad = [None, [None, *good[0][1:]], [float("nan"), *good[0][1:]], [float("inf"), *good[0][1:]], []]
    rows = [(i, v, 1) for i, v in enumerate([*good, *bad])] + [(None, good[0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *(F.lit(3).alias(c) for c in ("x", "list", "n", "w", "row", "v"))).repartition(5)
    got = whitening.whiten(table).collect()
    deviation, white, explained = plain_whitening([*good, good[0]])
    assert len(got) == 8 * (len(good) + 1) and {r.n for r in got} == {len(good) + 1}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        at = len(good) if r.vec_id is None else r.vec_id
        assert r.deviation == deviation[at] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        s = sign.setdefault(r.component, math.copysign(1, r.whitened * white[at, r.component - 1]))
        assert abs(s * r.whitened - white[at, r.component - 1]) < 1e-8
    assert whitening.whiten(table.where("vec_id is null and false")).collect() == []


def test_whitening_of_odd_tables(spark):
    said = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    one = said([(1, [0.5, 0.25, 1.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    lengths = said([(i, [float(i), 0.0]) for i in range(4)] + [(9, [float(9 + i)]) for i in range(3)])
    assert Counter((r.component, r.n, r.whitened is None) for r in lengths) == {(1, 4, False): 4, (2, 4, True): 4, (1, 3, False): 3}
    assert all(r.identity_error < 1e-12 for r in lengths)
    far = said([(1, [2.0**40]), (2, [0.0])])
    assert {r.deviation for r in far} == {None} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in far)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    for m in (a + a.T, a @ a.T, np.eye(n), np.zeros((n, n)), np.diag(np.arange(n) % 3.0), np.ones((n, n))):
        value, vector = whitening.symmetric_qr(m)
        size = np.abs(m).max() + 1.0
        assert np.allclose(value, np.linalg.eigvalsh(m)[::-1], atol=1e-13 * n * size)
        assert np.allclose(vector @ vector.T, np.eye(n), atol=1e-13 * n) and np.allclose(vector.T * value @ vector, m, atol=1e-12 * n * size)


def test_moments_merge_in_any_order():
    x = np.random.default_rng(2).standard_normal((60, 5)) + 1e6
    whole = whitening.Moments(5)
    for v in x:
        whole.add(v)
    assert np.allclose(whole.scatter, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-8, atol=1e-6)
    for row in range(5):
        parts = []
        for cut in (x[:1], x[1:7], x[7:]):
            m = whitening.Moments(5)
            for v in cut:
                m.add(v)
            parts.append((m.n, 0, m.mean, m.scatter[row]))
        a, b = whitening.merged(whitening.merged(parts[0], parts[1], row), parts[2], row), whitening.merged(parts[2], whitening.merged(parts[0], parts[1], row), row)
        assert np.allclose(a[3], b[3], atol=1e-6) and np.allclose(a[3], whole.scatter[row], atol=1e-6)
