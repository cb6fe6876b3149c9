"""Very long texts, whole: what stands at their ends counts."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from siltstone.llm import ctph, licenses, pieces, secrets, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_simhash(text, words):
    found = text.encode().lower().split()
    k = min(words, len(found))
    ones = [0] * 64
    for i in range(len(found) - k + 1):
        h = xxhash.xxh64_intdigest(b" ".join(found[i : i + k]), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(found) - k + 1)


def long_text(n, seed=1):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 9))) for _ in range(n))


def test_long_texts(spark):
    text = long_text(60_000)
    end = text + " token = 'abcdef12' released under the MIT License"
    docs = spark.createDataFrame([(1, text, "en", "a", 0), (2, end, "en", "a", 0), (3, "short", "en", "a", 0)], DOCS)
    prints = {r.doc_id: r for r in ctph.edited_fingerprints(docs).collect()}
    assert prints[1].n_chars == len(text) and prints[1].fingerprint == ctph.fingerprint(text.encode()) and prints[1].near_next > 0.5
    half = len(text) // 2
    assert prints[1].edited_sha256 == hashlib.sha256((text[: len(text) - half] + end[:half]).encode()).hexdigest()
    spans = {r.doc_id: [(end[s.start : s.end]) for s in r.spans] for r in secrets.scan(docs).collect()}
    assert spans[1] == [] and any("abcdef12" in s for s in spans[2])
    words = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert words[1].n_words == 60_000 and [p.at for p in words[2].phrases] == [60_005]
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.near_duplicates(docs, words=3, seed=42, radius=3).collect()}
    assert fps == {1: plain_simhash(text, 3), 2: plain_simhash(end, 3), 3: plain_simhash("short", 3)}


def test_long_pages(spark):
    html = "<p>" + long_text(300_000, 2) + "</p>"
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert bytes(got[1].payload) == html.encode() and (got[2].record_type, got[2].refers_to) == ("revisit", 1) and got[3].payload_bytes == 0


def test_toxic_words_at_the_end_of_a_long_text(spark):
    rng = random.Random(3)
    clean = ["".join(rng.choices(["an", "ti", "on", "re", "ou", "es"], k=rng.randint(2, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(clean, k=40)
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(40)] = "vilest"
            words[rng.randrange(40)] = "scumbag"
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(bad)))
    long = " ".join(rng.choices(clean, k=80_000))
    rows += [(1000, long, "en", "a", 0), (1001, long + " vilest scumbag vilest scumbag", "en", "a", 0)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.trained(docs, known)).collect()}
    assert found[1001].tox_score > found[1000].tox_score and found[1000].tox_score < toxicity.TOXIC
    assert any(s.start >= len(long) for s in found[1001].tox_spans) and len(found) == len(rows)


def test_a_long_part_without_a_space(spark):
    """A hundred thousand letters in one part, with and without pieces for them."""
    texts = [(1, "the" * 30_000), (2, "Ω" * 20_000), (3, "a b " * 20_000)]
    got = {r.doc_id: r for r in pieces.digests(spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("x"))).collect()}
    assert all(got[i].round_trip and got[i].n_pieces > 0 for i, _ in texts)
