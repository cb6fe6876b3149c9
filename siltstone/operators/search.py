"""Lexical and vector retrieval, and how their results are put together."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalar import cosine, folded, jaccard, tokens, unaccented
from siltstone.operators.shared import written

#: Words that a relaxed question does not ask for, and those that a question starts with (fixed values).
STOPWORDS = frozenset(
    (
        "a an the and or but if of to in on at by for with about from into over after before during as "
        "is are was were be been being am do does did done doing have has had having "
        "i me my we our us you your he she it its they them their this that these those there here "
        "what which who whom whose when where why how can could should would will shall may might must "
        "not no yes than then so just also very any some all each other such "
        "tell please give show find list explain"
    ).split()
)
LEADS = frozenset("what whats who whom whose when where why how which did does do is are was were can could should would will has have had tell find show list explain give".split())
#: A literal search with fewer hits is tried relaxed; words that make a question; content words at most; share of them that a hit has.
BELOW, SPOKEN, CONTENT, SHARE = 3, 3, 12, 0.6
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without marks, as documents are compared."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def parse_query(query: str) -> list[tuple[str, bool]]:
    """Phrases and whether each is a prefix: quotes group, ``""`` is a quote inside
    them, operators and tokens without a letter or digit drop out."""
    out = []
    for quoted, bare in re.findall(r'"((?:[^"]|"")*)"|(\S+)', query):
        text = quoted.replace('""', '"') if quoted else bare
        if not quoted and text in ("AND", "OR", "NOT", "NEAR"):
            continue
        words = _WORD.findall(plain(text))
        if words:
            out.append((" ".join(words), not quoted and text.endswith("*")))
    return out


def spans(text: Column, phrase: str, prefix: bool = False) -> Column:
    """Matches of a phrase as whole words, or of words that begin with it.  Neighbours share the mark between them, so
    only looks ahead and behind stand at the ends."""
    return F.regexp_count(unaccented(F.lower(text)), F.lit(rf"(?<![\p{{L}}\p{{N}}]){_form(phrase, prefix)}"))


def _form(phrase: str, prefix: bool) -> str:
    body = r"[^\p{L}\p{N}]+".join(map(re.escape, phrase.split()))
    return body + ("" if prefix else r"(?![\p{L}\p{N}])")


def literal(docs: DataFrame, query: str, title: str, body: str, key: str, limit: int | None, machine: Column | None = None, skip: int = 0) -> DataFrame:
    """Documents that hold all phrases, best first: an exact title, then score = (4 f(title) + f(body)) / (1000 + min(length,
    1000)), f(x) = x / (1 + x), halved for pages that a ``machine`` wrote.  A query without phrases finds none.  Without a ``limit`` all come, in no order."""
    parts = parse_query(query)
    if not parts:
        return docs.withColumns({"exact": F.lit(False), "score": F.lit(0.0)}).limit(0)
    counts = {f"_{c}{i}": spans(F.col(n), p, q) for i, (p, q) in enumerate(parts) for c, n in (("t", title), ("b", body))}
    counted = docs.withColumns(counts)  # each phrase is looked for once in each field
    keep = reduce(lambda x, i: x & (F.col(f"_t{i}") + F.col(f"_b{i}") > 0), range(len(parts)), F.lit(True))
    total = lambda c: sum((F.col(f"_{c}{i}") for i in range(len(parts))), F.lit(0))
    f = lambda x: x / (1 + x)
    weight = F.lit(1.0) if machine is None else F.when(machine, 0.5).otherwise(1.0)
    scored = counted.where(keep).withColumn("exact", F.lower(F.trim(title)) == query.strip().lower())
    scored = scored.withColumn("score", (4 * f(total("t")) + f(total("b"))) / (1000 + F.least(F.length(body), F.lit(1000))) * weight)
    scored = scored.drop(*counts)
    return scored if limit is None else scored.orderBy(F.desc("exact"), F.desc("score"), key).offset(skip).limit(limit)


def snippet(text: Column, terms: list[str], around: int = 160) -> Column:
    """40 characters before the first term found and 80 behind its start; the head of the text if there is none."""
    low = F.lower(text)
    at = F.coalesce(*(F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms)) if terms else F.lit(None).cast("int")
    head = F.when(F.length(text) <= around, text).otherwise(F.concat(F.substring(text, 1, around), F.lit("…")))
    start, end = F.greatest(F.lit(0), at - 41), F.least(F.length(text), at + 79)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at.isNull(), head).otherwise(cut)


def is_question(query: str) -> bool:
    """Three words or more that end in a question mark or start like a question; quotes and stars ask for the literal words."""
    spoken = _WORD.findall(plain(query))
    return not re.search(r'["*]', query) and len(spoken) >= SPOKEN and (query.rstrip().endswith("?") or spoken[0] in LEADS)


def _term(word: str) -> tuple[str, ...]:
    """Prefixes (with a star) or the word that stand for a content word."""
    if re.fullmatch(r"decid(?:e|ed|ing)|decisions?", word):
        return ("decid*", "decision*")  # the noun has another stem
    stem = word
    if word.isalpha():
        stem = next((word[: -len(x)] for x in ("ing", "ed", "es", "s") if word.endswith(x) and len(word) - len(x) >= 4), word)
        if stem.endswith("e") and len(stem) > 4:
            stem = stem[:-1]
    return (f"{stem}*",) if len(stem) >= 4 else (word,)


def relaxed_terms(question: str) -> tuple[list[tuple[str, ...]], int]:
    """What a question asks for, each term as its forms, and how many of them a document needs; none where the query is
    no question, has no content word, or more than CONTENT."""
    content = list(dict.fromkeys(w for w in _WORD.findall(plain(question)) if len(w) > 1 and w not in STOPWORDS)) if is_question(question) else []
    if not 0 < len(content) <= CONTENT:
        return [], 0
    terms = list(dict.fromkeys(map(_term, content)))
    return terms, math.ceil(len(terms) * SHARE)


def relaxed(docs: DataFrame, terms: list[tuple[str, ...]], need: int, body: str) -> DataFrame:
    """Documents that hold at least ``need`` of the terms, with their coverage: words that are, or begin with, a form."""
    if not terms:
        return docs.withColumns({"covered": F.lit(0), "coverage": F.lit(1.0)}).limit(0)
    forms = lambda term: "|".join(_form(f.rstrip("*"), f.endswith("*")) for f in term)
    held = lambda term: F.rlike("_low", F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{forms(term)})"))
    covered = sum((held(t).cast("int") for t in terms), F.lit(0))
    return docs.withColumn("_low", unaccented(F.lower(body))).withColumn("covered", covered).drop("_low").where(F.col("covered") >= need).withColumn("coverage", F.col("covered") / len(terms))


def search(docs: DataFrame, query: str, title: str, body: str, key: str, limit: int = 20, ledger: Column | None = None, bounded: bool = False) -> tuple[DataFrame, list[str]]:
    """Hits and labels.  A time bound leaves out what has no time (rows that ``ledger`` doesn't hold for).  A question with
    fewer than BELOW literal hits is asked again relaxed; the first page decides, a bounded count."""
    labels = []
    if not parse_query(query):
        return docs.limit(0), ["query-empty"]
    if bounded and ledger is not None:
        docs, labels = docs.where(ledger), ["canon-time-scope-unsupported"]
    found = literal(docs, query, title, body, key, limit).withColumn("coverage", F.lit(1.0))
    terms, need = relaxed_terms(query)
    if not terms or found.limit(BELOW).count() >= BELOW:
        return found, labels
    weak = relaxed(docs, terms, need, body).orderBy(F.desc("covered"), key).limit(limit)
    return weak, [*labels, "query-relaxed", *(["query-no-match"] if weak.isEmpty() else [])]


def bm25(docs: DataFrame, terms: list[str], key: str, body: str, title: str | None = None, k1: float = 1.2, b: float = 0.75, weight: float = 4.0) -> DataFrame:
    """(key, score) of documents that hold a term; a term in the title counts ``weight`` times.  Each text is cut into
    words once: its length and the counts of the terms go on, and one row of corpus counts joins by broadcast."""
    of = lambda column, t: F.size(F.filter(column, _equals(t)))
    words = docs.select(key, tokens(F.col(body)).alias("w"), (tokens(F.col(title)) if title else F.array().cast("array<string>")).alias("h"))
    length = F.size("w") + (weight * F.size("h") if title else F.lit(0))
    counts = [(of("w", t) + (weight * of("h", t) if title else F.lit(0))).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = words.select(key, length.cast("double").alias("len"), *counts)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    held = counted.where(reduce(lambda x, i: x | (F.col(f"tf{i}") > 0), range(len(terms)), F.lit(False)))
    return held.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def _equals(term: str):
    return lambda w: w == term


def term_score(docs: DataFrame, query: str, title: str, body: str) -> Column:
    """Four for each query term in the title, one for each in the body, however often."""
    terms = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return sum((4 * F.array_contains(words(F.col(title)), t).cast("int") + F.array_contains(words(F.col(body)), t).cast("int") for t in terms), F.lit(0))


def nearest(vectors: DataFrame, query: list[float], key: str, vector: str, limit: int) -> DataFrame:
    """Exact cosine over all permitted rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(limit)


#: Weight of an author's tier in fusion; that of corrections is fixed, the others are our own.
AUTHORITY_WEIGHT = {1: 0.8, 2: 1.0, 3: 1.5, 4: 2.0}


def fused(lists: list[DataFrame], key: str, k: int = 60, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of lists with column ``rank``, as a share of the best.  A column in ``carry`` is taken from
    whichever list has a value for it."""
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (x.select(key, "rank", *[c for c in carry if c in x.columns]) for x in lists))
    first = [F.first(c, ignorenulls=True).alias(c) for c in carry if c in every.columns]
    sums = every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.count(F.lit(1)).alias("n_lists"), *first)
    best = sums.agg(F.max("raw").alias("best"))
    return sums.crossJoin(F.broadcast(best)).withColumn("fused", F.col("raw") / F.col("best")).drop("raw", "best")


def weighted(rows: DataFrame, tier: Column) -> DataFrame:
    weights = F.create_map(*(x for t, w in AUTHORITY_WEIGHT.items() for x in (F.lit(t), F.lit(w))))
    return rows.withColumn("fused", F.col("fused") * F.coalesce(F.try_element_at(weights, tier), F.lit(1.0)))


def ranked(rows: DataFrame, score: str, key: str, limit: int = 1000) -> DataFrame:
    """The best ``limit`` rows with their ``rank``."""
    best = rows.orderBy(F.desc(score), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # of ``limit`` rows


def rescored(rows: DataFrame, fused_col: str, similarity: str) -> DataFrame:
    """0.7 of the fused score, as a share of the best, and 0.3 of the cosine."""
    best = rows.agg(F.max(fused_col).alias("_best"))
    blend = 0.7 * F.col(fused_col) / F.col("_best") + 0.3 * F.coalesce(similarity, F.lit(0.0))
    return rows.crossJoin(F.broadcast(best)).withColumn("score", blend).drop("_best")


def adjacency_boost(candidates: DataFrame, edges: DataFrame, key: str, score: str, least: int = 2, factor: float = 1.1) -> DataFrame:
    """Candidates next to ``least`` distinct other candidates or more are raised by ``factor``.  ``edges``: src, dst."""
    ids = candidates.select(F.col(key).alias("n")).distinct()
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = both.join(ids.withColumnRenamed("n", "src"), "src", "left_semi").join(ids.withColumnRenamed("n", "dst"), "dst", "left_semi")
    counts = near.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("neighbours"))
    met = candidates.join(counts, key, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    return met.withColumn(score, F.col(score) * F.when(F.col("neighbours") >= least, factor).otherwise(1.0))


def collapsed(chunks: DataFrame, key: str, score: str, *then: str) -> DataFrame:
    """The best chunk of each document."""
    best = F.max_by(F.struct(*chunks.columns), F.struct(F.col(score), *(-F.col(c) for c in then)))
    return chunks.groupBy(key).agg(best.alias("r")).select("r.*")


def layered(candidates: DataFrame, near: float = 0.85, share: float = 0.6) -> DataFrame:
    """Candidates (id, chunk, kind, text, score, corrected) without near copies inside a document, with at most a share of
    one kind; documents with a correction always keep one, and push nothing out.  A first page of candidates: bounded."""
    order = F.struct(F.col("score"), -F.col("chunk"))
    t = candidates.withColumn("t", F.array_distinct(tokens(F.col("text"))))
    a, b = t.alias("a"), t.alias("b")
    better = F.struct(F.col("a.score"), -F.col("a.chunk")) > F.struct(F.col("b.score"), -F.col("b.chunk"))
    copies = a.join(b, (F.col("a.id") == F.col("b.id")) & better & (jaccard(F.col("a.t"), F.col("b.t")) >= near)).select(F.col("b.id").alias("id"), F.col("b.chunk").alias("chunk")).distinct()
    plain = candidates.join(copies, ["id", "chunk"], "left_anti")
    total = candidates.agg(F.ceil(F.count(F.lit(1)) * share).alias("most"))
    by_kind = Window.partitionBy("kind").orderBy(order.desc(), "id")
    kept = plain.withColumn("n", F.row_number().over(by_kind)).crossJoin(F.broadcast(total)).where("n <= most").drop("n", "most")
    due = candidates.where("corrected").groupBy("id").agg(F.max_by(F.struct(*candidates.columns), order).alias("r")).select("r.*")
    due = due.join(kept.where("corrected").select("id").distinct(), "id", "left_anti").select(*candidates.columns)
    return kept.select(*candidates.columns).unionByName(due)


def reranked(candidates: DataFrame, judged: DataFrame, key: str, most: int = 63) -> DataFrame:
    """The first ``most`` candidates (key, rank) by an outside judge's score, those it does not know last, ties as before."""
    first = candidates.orderBy("rank", key).limit(most)
    return first.join(judged, key, "left").orderBy(F.desc_nulls_last("judged"), "rank", key)


def erased(index: DataFrame, gone: DataFrame, key: str, provenance: str) -> DataFrame:
    """The index without rows that are named (column ``key`` of ``gone``) or rest on a named event (column ``event``)."""
    events = gone.select("event").where("event IS NOT NULL").distinct()
    resting = index.select(key, F.explode(provenance).alias("event")).join(events, "event", "left_semi").select(key)
    named = gone.select(key).where(F.col(key).isNotNull())
    return index.join(resting.unionByName(named).distinct(), key, "left_anti")


def absent(index: DataFrame, gone: DataFrame, key: str, provenance: str) -> DataFrame:
    """What still stands in the index of what should be gone: no rows are the proof."""
    kept = erased(index, gone, key, provenance).select(key)
    return index.join(kept, key, "left_anti")


def label_matches(labels: DataFrame, query: str, key: str, label: str, after: int | None = None, page: int = 32) -> DataFrame:
    """A page of rows whose folded label holds the folded query, behind a key.  Full-width and like forms are plain letters."""
    want = " ".join(unicodedata.normalize("NFKC", query).upper().lower().split())
    found = labels.where(F.contains(folded(F.col(label)), F.lit(want)))
    found = found if after is None else found.where(F.col(key) > after)
    return found.orderBy(key).limit(page)


def slice_relevance(labels: DataFrame, task: str, label: str, key: str) -> DataFrame:
    """Rows by the number of the task's words in their label; all with none where no label has any."""
    words = sorted(set(re.findall(r"\w+", task.lower())))
    scored = labels.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(tokens(F.col(label))), F.array(*map(F.lit, words)).cast("array<string>"))))
    best = scored.agg(F.max("overlap").alias("best"))
    return scored.crossJoin(F.broadcast(best)).where("overlap > 0 OR best = 0").drop("best").orderBy(F.desc("overlap"), key)


def term_relevance(claims: DataFrame, query: str, fields: list[str]) -> Column:
    """How many of the query's terms each of the fields holds, summed."""
    terms = sorted(set(re.findall(r"\w+", query.lower())))
    return sum((F.contains(F.lower(F.col(c)), F.lit(t)).cast("int") for c in fields for t in terms), F.lit(0))


def unfolded(events: DataFrame, pages: DataFrame, event: str, sources: str) -> DataFrame:
    """Events that no selected page cites."""
    return events.join(pages.select(F.explode(sources).alias(event)).distinct(), event, "left_anti")


def chunks(docs: DataFrame, key: str, body: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """Overlapping runs of words: (key, chunk, n_words, text)."""
    words = F.filter(F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " "), lambda w: w != "")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / step).cast("int") - 1)
    cut = F.slice("w", F.col("chunk") * step + 1, F.lit(size))
    rows = docs.select(key, words.alias("w")).where(F.size("w") > 0).select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.size(cut).cast("long").alias("n_words"), F.array_join(cut, " ").alias("text"))


def _claim_sets(claims: DataFrame, key: str, body: str) -> DataFrame:
    """k, t, name: each claim's distinct tokens in order, spaced, and 128 bits that stand for them."""
    base = claims.select(F.col(key).alias("k"), F.array_join(F.array_sort(F.array_distinct(tokens(F.col(body)))), " ").alias("t"))
    return base.select("k", "t", F.concat_ws(":", F.xxhash64("t"), F.xxhash64(F.lit(1), "t")).alias("name"))


def near_members(claims: DataFrame, key: str, body: str) -> DataFrame:
    """For each key the name of its token set: the set's smallest key."""
    base = _claim_sets(claims, key, body)
    sets = base.groupBy("name").agg(F.min("k").alias("set_id"))
    return base.select("k", "name").join(sets, "name").select(F.col("k").alias(key), "set_id")


#: Counters of how many sets hold a token, by its hash; tokens whose sets are ordered at once, about; tokens that two alike
#: sets must share among their rarest to be compared, and for how many that they share in all it is one more.
COUNTERS, TOKENS, SHARED, MORE = 1 << 20, 1 << 19, 4, 32
#: What a tile of sets weighs at least and at most, a set APIECE and a unit for each of its rarest tokens; how many tiles
#: there are where they are lighter; matches of tokens looked at together; sets of a cell in which pairs are compared; and
#: how many keys are broadcast at most.
TILE, APIECE, TILES, MATCHES, CELL, KEYS = (1 << 16, 10_000_000), 64, 12, 1 << 20, 1000, 1 << 20


def _each(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends, from 0 on, and values of a column of lists of numbers."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]]


def _counted(sets: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """For sets (h: hashes of the tokens) how many hold a token, by counters, and how many there are of each size."""

    def run(batches):
        held, sizes = np.zeros(COUNTERS, np.int64), Counter()
        for batch in batches:
            ends, h = _lists(batch.column(0))
            held += np.bincount(h & (COUNTERS - 1), minlength=COUNTERS)
            sizes.update(np.diff(ends).tolist())
        for of_size, c, n in ((False, np.flatnonzero(held), held[held > 0]), (True, list(sizes), list(sizes.values()))):
            yield pa.RecordBatch.from_arrays([pa.array([of_size] * len(c), pa.bool_()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["of_size", "c", "n"])

    found = sets.select("h").mapInArrow(run, "of_size boolean, c long, n long").groupBy("of_size", "c").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows and one a size
    of_size, c, n = (found[x].to_numpy() for x in ("of_size", "c", "n"))
    counts = np.zeros(COUNTERS, np.int64)
    counts[c[~of_size]] = n[~of_size]
    return counts, dict(zip(c[of_size].tolist(), n[of_size].tolist(), strict=True))


def _least(size, other, threshold: float):
    """Tokens that sets of these sizes share at the threshold."""
    return np.ceil(threshold / (1 + threshold) * (size + other) - 1e-9).astype(np.int64)


def _first(least):
    """How many of the tokens that two sets must share are looked for among their rarest: long sets meet in some by chance."""
    return np.minimum(least, SHARED + least // MORE)


def _tiles(sizes: dict[int, int], threshold: float) -> tuple[np.ndarray, ...]:
    """Tiles of sets of neighbouring sizes: each size, its first tile and how many it has; the least and greatest size of each tile."""
    weight = lambda s: APIECE + int(s - _least(s, threshold * s, threshold) + _first(_least(s, threshold * s, threshold)))
    room = min(max(TILE[0], math.ceil(sum(n * weight(s) for s, n in sizes.items()) / TILES)), TILE[1])
    first, parts, low, high, held = [], [], [], [], room
    for s, n in sorted(sizes.items()):
        w = n * weight(s)
        k = math.ceil(w / room)
        if held + w <= room:
            high[-1], held = s, held + w
        else:
            low, high, held = low + [s] * k, high + [s] * k, w if k == 1 else room
        first.append(len(low) - k)
        parts.append(k)
    return tuple(np.array(x, np.int64) for x in (sorted(sizes), first, parts, low, high))


def _words(size):
    """Words of 64 bits in the parities of a set: the power of two from its size on."""
    return np.maximum(64, 1 << np.ceil(np.log2(size)).astype(np.int64)) // 64


def _parities(size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set as many bits, each the parity of how many of its hashes fall there, one set's words behind another's."""
    words = _words(size)
    begin = (np.cumsum(words) - words) * 64
    at = np.repeat(begin, size) + (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % np.repeat(words * 64, size)
    return np.packbits((np.bincount(at, minlength=int(words.sum()) * 64) & 1).astype(np.uint8), bitorder="little").view("<u8")


def _alike(size: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets i and j may have the similarity: each bit in which their parities differ is a token of one of them alone."""
    words = _words(size)
    begin = np.cumsum(words) - words
    swap = words[i] > words[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    kind, differ = words[i] << 32 | words[j], np.zeros(len(i), np.int64)
    for x in np.unique(kind).tolist():
        w, pairs = x >> 32, np.flatnonzero(kind == x)
        for part in np.array_split(pairs, math.ceil(len(pairs) * w / MATCHES)):
            both = bits[begin[i[part], None] + np.arange(w)]
            for at in range(0, x & (1 << 32) - 1, w):  # what are several bits there is one here
                both ^= bits[begin[j[part], None] + np.arange(at, at + w)]
            differ[part] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return differ <= size[i] + size[j] - 2 * _least(size[i], size[j], threshold)


def _dealt(sets: DataFrame, threshold: float, counts: np.ndarray, sizes: dict[int, int]) -> DataFrame:
    """a, b, tile, k, size, h, bits: each set (k, h: hashes of its tokens) at each pair of tiles, its own and one with sets
    that its size allows, with the hashes of its rarest tokens, as many as a pair may need there, and parities of all.

    Rare is what few sets hold by ``counts``, then by hash: any order that all sets have in common gives the same pairs."""
    known, first, parts, low, high = _tiles(sizes, threshold)
    smallest = np.ceil(threshold * known - 1e-9).astype(np.int64)
    nearest, last = np.searchsorted(high, smallest), np.searchsorted(low, np.floor(known / threshold + 1e-9), "right") - 1

    def slices(batches):
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            cuts = np.flatnonzero(np.diff((ends[1:] - ends[0]) // TOKENS)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield batch.slice(start, end - start)

    def run(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            ends, h = _lists(batch.column(1))
            size = np.diff(ends).astype(np.int64)
            at = np.searchsorted(known, size)
            tile = first[at] + (np.add.reduceat(h.view(np.uint64), ends[:-1]) % parts[at].astype(np.uint64)).astype(np.int64)
            rarest = h[np.lexsort((h, counts[h & (COUNTERS - 1)], np.repeat(np.arange(len(size)), size)))].astype(np.int32)
            copies = last[at] - nearest[at] + 1
            of = np.repeat(np.arange(len(size)), copies)
            other = nearest[at][of] + _each(copies)
            least = _least(size[of], np.maximum(low[other], smallest[at][of]), threshold)
            most = np.minimum(size[of] - least + _first(least), size[of])
            shown = rarest[np.repeat(ends[:-1][of], most) + _each(most)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(most))), pa.int32()), pa.array(shown))
            a, b, own, held = (pa.array(x.astype(np.int32)) for x in (np.minimum(tile[of], other), np.maximum(tile[of], other), tile[of], size[of]))
            end = np.concatenate(([0], np.cumsum(_words(size) * 8))).astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(end), pa.py_buffer(_parities(size, h))]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([a, b, own, batch.column(0).take(pa.array(of)), held, lists, bits], names=["a", "b", "tile", "k", "size", "h", "bits"])

    kind = sets.schema["k"].dataType.simpleString()
    return sets.select("k", "h").mapInArrow(run, f"a int, b int, tile int, k {kind}, size int, h array<int>, bits binary")


def _sharing(size: np.ndarray, ends: np.ndarray, h: np.ndarray, left: np.ndarray | None, threshold: float, matches: int):
    """Pairs of sets (rows of their sizes, and their rarest hashes in order) that share as many tokens as ``_first`` tells at
    places where alike sets have them: of rows that are ``left`` and rows that are not, or of all."""
    count = np.diff(ends)
    doc, room = np.repeat(np.arange(len(size), dtype=np.int32), count), (np.repeat(size, count) - _each(count) - 1).astype(np.int32)

    def sorted_by_hash(rows):
        rows = rows.astype(np.int32)
        return rows[np.argsort(h[rows], kind="stable")]

    right = sorted_by_hash(np.arange(len(h)) if left is None else np.flatnonzero(~left[doc]))
    order = right if left is None else sorted_by_hash(np.flatnonzero(left[doc]))
    of_right, of_left = h[right], h[order]
    low = np.arange(1, len(h) + 1) if left is None else np.searchsorted(of_right, of_left)  # of all, with those behind it alone
    many = np.searchsorted(of_right, of_left, "right") - low
    by_row = np.flatnonzero(many)
    by_row = by_row[np.argsort(order[by_row])]
    order, low, many = order[by_row], low[by_row], many[by_row]
    total = np.cumsum(many)
    del of_right, of_left, by_row
    kept, start, n = np.zeros(0, np.int64), 0, len(size)
    while start < len(order):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + matches, "right")))
        x = np.repeat(order[start:end], many[start:end])
        y = right[np.repeat(low[start:end], many[start:end]) + _each(many[start:end])]
        i, j = doc[x].astype(np.int64), doc[y]
        least = _least(size[i], size[j], threshold)
        fits = (np.minimum(room[x], room[y]) + _first(least) >= least) & (least <= np.minimum(size[i], size[j]))
        kept = np.concatenate((kept, i[fits] * n + j[fits]))
        start = end
        done = n * n if start == len(order) else int(doc[order[start]]) * n  # what the next matches may add to waits
        pair, times = np.unique(kept[kept < done], return_counts=True)
        kept = kept[kept >= done]
        i, j = pair // n, pair % n
        enough = times >= _first(_least(size[i], size[j], threshold))
        yield i[enough], j[enough]


def _compared(words: pa.Array, k: pa.Array, others: pa.Array, threshold: float):
    """Rows i and j, and similarity, of pairs at the threshold: of each row's spaced ``words`` and those of the rows whose ``k`` its ``others`` name."""
    known: dict[str, int] = {}
    sets = [np.fromiter((known.setdefault(w, len(known)) for w in x.split(" ")), np.int64) for x in words.to_pylist()]
    size = np.array([len(x) for x in sets])
    begin, flat = np.cumsum(size) - size, np.concatenate(sets)
    number = pa.concat_arrays([k, others.flatten()]).dictionary_encode().indices.to_numpy()
    own, asked = number[: len(k)], number[len(k) :]
    order = np.argsort(own, kind="stable")
    low, high = np.searchsorted(own[order], asked), np.searchsorted(own[order], asked, "right")
    i = np.repeat(np.repeat(np.arange(len(k)), np.diff(others.offsets.to_numpy())), high - low)
    j = order[np.repeat(low, high - low) + _each(high - low)]
    held, shared = np.zeros(len(known), bool), np.zeros(len(i), np.int64)
    cuts = np.flatnonzero(np.diff(i)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
        if start < end:
            held[sets[i[start]]] = True
            n = size[j[start:end]]
            met = held[flat[np.repeat(begin[j[start:end]], n) + _each(n)]]
            shared[start:end] = np.add.reduceat(met, np.cumsum(n) - n, dtype=np.int64)
            held[sets[i[start]]] = False
    likeness = shared / (size[i] + size[j] - shared)
    near = likeness >= threshold
    return i[near], j[near], likeness[near]


def _by_cell(pairs: DataFrame) -> DataFrame:
    """home, x, y, k, others: the cells in which pairs (left_id, right_id) are compared, each with the keys that it needs
    and for each the keys that it is compared with.

    A pair's home is the smallest key that its left one meets, so that a group of near copies comes together and a set
    goes to few homes.  A home with many keys has a square of cells, which its left keys know, as its pairs may be very many."""
    both = pairs.select(F.col("left_id").alias("k"), F.col("right_id").alias("o")).unionByName(pairs.select(F.col("right_id").alias("k"), F.col("left_id").alias("o")))
    homes = both.groupBy("k").agg(F.least("k", F.min("o")).alias("home"))
    keys = pairs.join(homes.withColumnRenamed("k", "left_id"), "left_id").select("home", F.explode(F.array("left_id", "right_id")).alias("k")).distinct()
    wide = keys.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts")).where("parts > 1")
    homes = homes.join(wide, "home", "left").select(F.col("k").alias("left_id"), "home", F.coalesce("parts", F.lit(1)).alias("parts"))
    placed = pairs.join(homes, "left_id")
    cell = ["home", *(F.pmod(F.xxhash64(c), "parts").cast("int").alias(n) for c, n in (("left_id", "x"), ("right_id", "y")))]
    lefts = placed.select(*cell, F.col("left_id").alias("k"), F.col("right_id").alias("o"))
    rights = placed.select(*cell, F.col("right_id").alias("k"), F.lit(None).cast(pairs.schema["left_id"].dataType).alias("o"))
    return lefts.unionByName(rights).groupBy("home", "x", "y", "k").agg(F.collect_set("o").alias("others"))


def near_claims(claims: DataFrame, key: str, body: str, threshold: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of distinct token sets, each named by its smallest key, with a Jaccard similarity at the
    threshold or above, and for each key the name of its set.

    Equal sets are one, so copies make no pairs.  Of sets a and b that share o tokens or more, the first c that they share,
    from the rarest on, stand at places up to |a| - o + c and |b| - o + c.  Only pairs that share as many there, and whose
    parities do not rule them out, are compared by the sets themselves.  What sets share is counted by pairs of tiles, each in one task of bounded size, so that no match
    of single tokens is shuffled; and a set goes once to each cell that compares it, not to each pair."""
    sets = _claim_sets(claims, key, body).groupBy("name").agg(F.min("k").alias("k"), F.max("t").alias("t")).where("t <> '' AND k IS NOT NULL")
    sets = written(sets.select("k", "t"), "claim-sets")
    hashed = sets.select("k", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h"))
    dealt = _dealt(hashed, threshold, *_counted(hashed))
    matches = MATCHES

    def meet(at, rows):
        rows = rows.combine_chunks()
        tile, k = rows["tile"].to_numpy(), rows["k"].combine_chunks()
        size, bits = rows["size"].to_numpy().astype(np.int64), np.frombuffer(b"".join(rows["bits"].to_pylist()), "<u8")
        found = _sharing(size, *_lists(rows["h"].combine_chunks()), tile == at[0].as_py() if at[0] != at[1] else None, threshold, matches)
        near = ((i[keep], j[keep]) for i, j in found for keep in [_alike(size, bits, i, j, threshold)])
        i, j = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *near, strict=True))
        return pa.table({"i": k.take(pa.array(i)), "j": k.take(pa.array(j))})

    def compare(_, rows):
        k = rows["k"].combine_chunks()
        i, j, likeness = _compared(rows["t"].combine_chunks(), k, rows["others"].combine_chunks(), threshold)
        return pa.table({"left_id": k.take(pa.array(i)), "right_id": k.take(pa.array(j)), "similarity": pa.array(likeness)})

    kind = sets.schema["k"].dataType.simpleString()
    met = dealt.groupBy("a", "b").applyInArrow(meet, f"i {kind}, j {kind}").where("i <> j")
    met = written(met.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id")), "claim-pairs")
    keys = written(met.select(F.explode(F.array("left_id", "right_id")).alias("k")).distinct(), "claim-keys")
    used = sets.join(F.broadcast(keys) if keys.count() <= KEYS else keys, "k", "left_semi")
    cells = _by_cell(met).join(used, "k").select("home", "x", "y", "k", "others", "t")
    return cells.groupBy("home", "x", "y").applyInArrow(compare, f"left_id {kind}, right_id {kind}, similarity double"), near_members(claims, key, body)


def eval_metrics(ranks: DataFrame, kind: str, rank: str) -> DataFrame:
    """hit@1, hit@5, hit@20, mean reciprocal rank, and the share that found nothing; a null rank is a miss."""
    hit = lambda k: F.avg((F.coalesce(F.col(rank), F.lit(1 << 30)) <= k).cast("double"))
    return ranks.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), hit(20).alias("hit_20"), F.avg(F.col(rank).isNull().cast("double")).alias("abstained"), F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))
