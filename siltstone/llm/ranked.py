"""Ranked lexical search by block-max pruning over a forward index.

Documents are indexed in blocks of neighbours, so a block is a range of
documents.  A block's forward index has, for each document, its length and how
often each asked term occurs; with the counts over all documents known, a block
also has the most that each term gives any of its documents.  An item's bound
for a block sums these.  A task takes the blocks of a window, sorts them by an
item's bound and scores one after another until the bound falls below the
item's threshold: the least of the best scores so far.  A first pass scores an
item's best block in each window, so that thresholds of the second pass hold
over all tasks.  Scores are exact integers, and what is skipped can't be among
the best.

Null and wordless texts and items match nothing; texts of any length are read
whole.  Equal scores are ordered by id, null ids last.  Documents that repeat an
id, or a whole row, are ranked each by itself.  Items that repeat id and text
are one item; items that share only the id have each a list.  Other columns are
ignored; an empty table on either side gives an empty result.

Asked terms are collected in groups of about ``ASKED`` and documents are read
once a group, so no size is left to chance.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stored

#: Documents of a block; postings after which a block ends whatever its documents; blocks and postings of a window.
BLOCK, POSTINGS, WINDOW, HELD = 256, 1 << 16, 256, 1 << 22
#: Pairs of an item and a term that a group of items has, about.
ASKED = 1 << 20

#: Bytes as terms see them: letters and digits and all of what isn't ASCII stay, A-Z in lower case, the rest parts terms.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Questions(NamedTuple):
    """A group of items: ``ids`` (item ids), and term numbers and repeats of item i at ``start[i]`` to ``start[i + 1]``."""

    ids: list
    numbers: dict[bytes, int]
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray


class Weights(NamedTuple):
    documents: int
    words: int
    term: np.ndarray  # by term number


class Block(NamedTuple):
    docs: list
    n: np.ndarray
    start: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def asked(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (its number by content), item_id, term, times: a row for each term of an item."""

    def run(batches):
        for batch in batches:
            rows = [(a, i, t, c) for a, i, text in zip(*(x.to_pylist() for x in batch.columns), strict=True) for t, c in Counter(terms(text or b"")).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "item_id", "term", "times"])

    one = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    return one.select(key.alias("item"), "item_id", F.col("text").cast("binary")).mapInArrow(run, "item string, item_id long, term binary, times long")


def questions(rows) -> Questions:
    by_item: dict = {}
    for r in rows:
        by_item.setdefault((r["item"], r["item_id"]), []).append((bytes(r["term"]), r["times"]))
    numbers: dict[bytes, int] = {}
    term, times, start = [], [], [0]
    for pairs in by_item.values():
        for t, c in sorted(pairs):
            term.append(numbers.setdefault(t, len(numbers)))
            times.append(c)
        start.append(len(term))
    return Questions([i for _, i in by_item], numbers, np.array(start), np.array(term, np.int64), np.array(times, np.int64))


FORWARD = "documents long, words long, docs array<long>, n array<long>, start array<int>, term array<int>, tf array<int>, seen array<int>, df array<int>"


def forward(docs: DataFrame, asks: Questions, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """FORWARD: a row a block.  ``documents`` and ``words`` count all documents with a term, the lists those with an asked one."""
    spark = docs.sparkSession
    numbers = spark.sparkContext.broadcast(asks.numbers)

    def row(documents, words, held):
        term = np.fromiter((t for _, _, found in held for t, _ in found), np.int32)
        tf = np.fromiter((c for _, _, found in held for _, c in found), np.int32)
        start = np.concatenate(([0], np.cumsum([len(found) for _, _, found in held]))).astype(np.int32)
        seen, df = np.unique(term, return_counts=True)
        lists = ([i for i, _, _ in held], pa.int64()), ([n for _, n, _ in held], pa.int64()), (start, pa.int32()), (term, pa.int32()), (tf, pa.int32()), (seen, pa.int32()), (df.astype(np.int32), pa.int32())
        arrays = [pa.array([documents], pa.int64()), pa.array([words], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in lists)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FORWARD.split(", ")])

    def run(batches):
        known = numbers.value
        documents = words = postings = 0
        held = []
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = terms(text.as_py() or b"")
                if not said:
                    continue
                documents, words = documents + 1, words + len(said)
                counts = Counter(said)
                found = [(known[t], counts[t]) for t in counts.keys() & known.keys()]
                if found:
                    held.append((id_, len(said), found))
                    postings += len(found)
                    if len(held) == block or postings >= POSTINGS:
                        yield row(documents, words, held)
                        documents = words = postings = 0
                        held = []
        if documents:
            yield row(documents, words, held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, FORWARD)


def weights(blocks: DataFrame, asks: Questions) -> Weights:
    """Counts over all documents: two numbers, and one for each asked term."""
    documents, words = blocks.agg(F.sum("documents"), F.sum("words")).first()
    documents, words = documents or 0, words or 0
    pairs = blocks.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df").alias("df")).collect()
    out = np.zeros(len(asks.numbers), np.int64)
    for seen, df in pairs:
        out[seen] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return Weights(documents, words, out)


def gains(b: Block, w: Weights) -> np.ndarray:
    """What each posting gives for a weight of one."""
    m = 100 - 75 + (75 * b.n * w.documents) // w.words
    tf = b.tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(b.start)))


class Best:
    """The best ``most`` documents of an item so far, and the score below which none gets in."""

    def __init__(self, least: int, most: int):
        self.least, self.most, self.rows = least, most, []

    def add(self, docs, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= max(self.least, 1))
        if len(at):
            self.rows += [(-int(scores[i]), docs[i] is None, docs[i] or 0) for i in at]
            self.rows.sort()
            del self.rows[self.most :]
            if len(self.rows) == self.most:
                self.least = max(self.least, -self.rows[-1][0])


def search_window(blocks: list[Block], asks: Questions, w: Weights, best: dict[int, Best], first: bool = False) -> int:
    """Add to ``best`` what the blocks hold; only each item's best block with ``first``.  Returns how often a block was scored."""
    worth = asks.times * w.term[asks.term]
    gain, bound = [], np.zeros((len(blocks), len(asks.ids)), np.int64)
    for k, b in enumerate(blocks):
        gain.append(gains(b, w))
        peak = np.zeros(len(w.term), np.int64)
        np.maximum.at(peak, b.term, gain[-1])
        bound[k] = np.add.reduceat(worth * peak[asks.term], asks.start[:-1])
    scored, own = 0, np.zeros(len(w.term), np.int64)
    for i, mine in best.items():
        mark = slice(asks.start[i], asks.start[i + 1])
        own[asks.term[mark]] = worth[mark]
        order = np.argsort(-bound[:, i], kind="stable")
        for k in order[:1] if first else order:
            if bound[k, i] < max(mine.least, 1):
                break
            b = blocks[k]
            sums = np.concatenate(([0], np.cumsum(own[b.term] * gain[k])))
            mine.add(b.docs, sums[b.start[1:]] - sums[b.start[:-1]])
            scored += 1
        own[asks.term[mark]] = 0
    return scored


def search_blocks(blocks: DataFrame, asks: Questions, w: Weights, least: np.ndarray, most: int, first: bool = False, window: int = WINDOW) -> DataFrame:
    """item (number), doc_id, score: the best of each task."""
    known = blocks.sparkSession.sparkContext.broadcast((asks._replace(numbers={}), w, least))

    def run(batches):
        asks, w, least = known.value
        best = {i: Best(int(least[i]), most) for i in range(len(asks.ids))}
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                docs, *lists = (c[k] for c in batch.columns)
                b = Block(docs.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in lists))
                if not len(b.docs):
                    continue
                held.append(b)
                size += len(b.term)
                if len(held) == window or size >= HELD:
                    search_window(held, asks, w, best, first)
                    held, size = [], 0
        if held:
            search_window(held, asks, w, best, first)
        rows = [(i, None if none else d, -s) for i, mine in best.items() for s, none, d in mine.rows]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return blocks.select("docs", "n", "start", "term", "tf").mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    pairs = stored(asked(items, item_col, item_text_col), "asked")
    groups = -(-pairs.count() // ASKED)
    out = []
    for g in range(groups):
        asks = questions(pairs.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect())
        if not asks.ids:
            continue
        blocks = stored(forward(docs, asks, id_col, text_col, block), "forward")
        w = weights(blocks, asks)
        if not w.documents:
            continue
        least = np.zeros(len(asks.ids), np.int64)
        seeds = ranked(search_blocks(blocks, asks, w, least, most, True, window), most).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == most)
        for r in seeds.collect():  # a row an item
            least[r["item"]] = r["least"]
        names = spark.createDataFrame(list(enumerate(asks.ids)), "item int, item_id long")
        best = ranked(search_blocks(blocks, asks, w, least, most, False, window), most)
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
 g AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS words FROM d WHERE len(t) > 0),
 f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
 q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
