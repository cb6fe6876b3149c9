"""Toxicity by a linear-chain conditional random field over words.

The model is fitted on the driver to a sample of labelled documents of bounded
size (``SAMPLE`` of either label, chosen by a hash of the id; none of more than
``LONGEST`` characters, so the sample's bytes are bounded too).  Words of its toxic
documents that stand out against its clean ones, themselves or by how they begin,
are the labelled words of the toxic spans; all other words are labelled clean.
The chain has two states; its weights on words, beginnings of words, and pairs
of neighbouring states follow by gradient ascent of the regularised
likelihood.  Every document is then scored whole: forward-backward marginals
of its words give the score and the offsets of the words that offend.

Only the text is scored, whole whatever its length.  Null and empty texts score zero.  Labels that are null
are left out; of several for one id the largest counts.  Rows may repeat; named
columns are carried, others ignored.  Without a labelled row of both kinds no
word is toxic and scores are zero.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Labelled documents of each label that the model is fitted to, at most.
SAMPLE = 2000
#: Characters of a document in the sample, at most.
LONGEST = 1 << 15
#: Words in a training sequence; scoring always takes whole texts.
SEQUENCE = 64
#: Score from which a document is called toxic, and marginal from which a word offends.
TOXIC, OFFENDS = 0.7, 0.5
#: Marginals below this don't add up over a long text.
COUNTS = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Words whose weights a worker remembers.
MEMORY = 400_000


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6, 7) if len(word) > k)]


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` documents of either label that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    one = known.where("toxic = 1").orderBy(*order).limit(most).unionByName(known.where("toxic = 0").orderBy(*order).limit(most))
    # at most twice ``most`` rows are broadcast and collected: of several texts for one id the greatest
    asked = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(one), "doc_id")
    rows = asked.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def distinct(read: list[tuple[list[str], int]], words: int = 3, most: float = 0.5) -> list[tuple[list[str], int]]:
    """The sample without copies and near copies, which would make chance words
    look common: a document stays if at most ``most`` of its shingles were seen."""
    seen: set[int] = set()
    out = []
    for found, label in read:
        own = {hash(tuple(found[i : i + words])) for i in range(max(1, len(found) - words + 1))}
        if len(own & seen) <= most * len(own):
            out.append((found, label))
        seen |= own
    return out


def toxic_words(sample: list[tuple[list[str], int]], chance: float = 1e-6, odds: float = 8.0) -> set[str]:
    """Features that mark words of toxic spans: far likelier in toxic documents than
    in clean ones, by more than ``chance`` would make of one feature in a million."""
    counts = Counter(), Counter()
    for words, label in sample:
        counts[label].update({f for w in set(words) for f in features(w)})
    n = [sum(1 for _, y in sample if y == k) for k in (0, 1)]
    clean, toxic = counts
    share = n[1] / (n[0] + n[1])

    def stands_out(f: str) -> bool:
        t, c = toxic[f], clean[f]
        if (t + 0.5) / (n[1] + 1) <= odds * (c + 0.5) / (n[0] + 1):
            return False
        ways = math.lgamma(t + c + 1) - math.lgamma(t + 1) - math.lgamma(c + 1)
        return ways + t * math.log(share) + c * math.log(1 - share) < math.log(chance)

    return {f for f in toxic if stands_out(f)}


class Chain:
    """Weights: ``unary`` of features for the toxic state, ``bias``, and ``pair`` of neighbouring states."""

    def __init__(self, unary: dict[str, float], bias: float, pair: list[list[float]]):
        self.unary, self.bias, self.pair = unary, bias, pair
        self.memory: dict[str, float] = {}
        self.plain: dict[int, float] = {}

    def weight(self, word: str) -> float:
        """What a word adds to the toxic state; 0 for words without a feature."""
        found = self.memory.get(word)
        if found is None:
            found = sum(self.unary.get(f, 0.0) for f in features(word))
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = found
        return found

    def marginals(self, weights: list[float]) -> list[float]:
        """Probability of the toxic state at each word, by forward-backward on the odds of the two states."""
        (p00, p01), (p10, p11) = [[math.exp(x) for x in row] for row in self.pair]
        factor = [math.exp(self.bias + w) for w in weights]
        ahead, r = [], None
        for f in factor:  # odds of state 1 given what came so far
            r = f if r is None else f * (p01 + r * p11) / (p00 + r * p10)
            ahead.append(r)
        out, s = [0.0] * len(factor), 1.0
        for i in range(len(factor) - 1, -1, -1):  # s: odds of what follows
            odds = ahead[i] * s
            out[i] = odds / (1.0 + odds)
            g = factor[i] * s
            s = (p10 + p11 * g) / (p00 + p01 * g)
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The document's score and the offending words as [start, end) in code points."""
        if not text:
            return 0.0, []
        low = text.lower()
        words = WORD.findall(low)
        if not words or not self.unary:
            return 0.0, []
        memory = self.memory
        weights = [*map(memory.get, words)]
        if None in weights:
            weights = [self.weight(words[i]) if w is None else w for i, w in enumerate(weights)]
        if not any(weights):  # all such texts of a length are alike
            n = len(words)
            if n not in self.plain:
                self.plain[n] = max(self.marginals(weights))
            return self.plain[n], []
        p = self.marginals(weights)
        whole = 1.0 - math.prod(1.0 - x for x in p if x >= COUNTS)
        bad = [i for i, x in enumerate(p) if x >= OFFENDS]
        if not bad:
            return max(whole, max(p)), []
        if len(low) == len(text):
            at = [m.span() for m in WORD.finditer(low)]
        else:  # some letters grow when lower-cased: take the words as they stand
            at = [m.span() for m in WORD.finditer(text)]
            bad = [i for i in bad if i < len(at)]
        return whole, [at[i] for i in bad]


def fit(sample: list[tuple[str, int]], rounds: int = 50, rate: float = 0.4, penalty: float = 0.5) -> Chain:
    """Regularised maximum likelihood by Adam on sequences of the sample's words."""
    read = distinct([(WORD.findall(text.lower()), y) for text, y in sample])
    marks = toxic_words(read) if len({y for _, y in read}) == 2 else set()
    if not marks:
        return Chain({}, -20.0, [[0.0, 0.0], [0.0, 0.0]])
    names = sorted({f for words, y in read if y for w in set(words) if any(g in marks for g in features(w)) for f in features(w)})
    number = {f: i for i, f in enumerate(names)}
    known: dict[str, tuple[tuple[int, ...], bool]] = {}
    for w in {w for words, _ in read for w in words}:
        known[w] = tuple(number[f] for f in features(w) if f in number), any(f in marks for f in features(w))
    # equal sequences, such as those without a feature of one length, are one with a weight
    folded: Counter[tuple[tuple[tuple[int, ...], ...], tuple[int, ...]]] = Counter()
    for words, y in read:
        for at in range(0, len(words), SEQUENCE):
            part = [known[w] for w in words[at : at + SEQUENCE]]
            folded[tuple(fs for fs, _ in part), tuple(int(bool(y) and marked) for _, marked in part)] += 1
    rows, times = list(folded), np.array(list(folded.values()), np.float64)
    n, steps = len(rows), SEQUENCE
    gold, mask = np.zeros((n, steps)), np.zeros((n, steps), bool)
    where, which = [], []
    for i, (fs, ys) in enumerate(rows):
        gold[i, : len(ys)], mask[i, : len(ys)] = ys, True
        for t, ids in enumerate(fs):
            where += [i * steps + t] * len(ids)
            which += ids
    where, which = np.array(where, np.int64), np.array(which, np.int64)
    theta = np.zeros(len(names) + 5)  # features, bias, pairs
    theta[len(names)] = -4.0
    m = v = np.zeros_like(theta)
    both = mask[:, 1:]
    g0, g1 = gold[:, :-1].astype(int), gold[:, 1:].astype(int)
    for k in range(1, rounds + 1):
        w, bias, pair = theta[: len(names)], theta[len(names)], theta[len(names) + 1 :].reshape(2, 2)
        u = np.bincount(where, w[which], n * steps).reshape(n, steps) + bias
        a, b = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        a[0, :, 1] = u[:, 0]
        for t in range(1, steps):
            step = a[t - 1][:, :, None] + pair
            a[t] = np.logaddexp(step[:, 0], step[:, 1])
            a[t, :, 1] += u[:, t]
            a[t] = np.where(mask[:, t, None], a[t], a[t - 1])
        for t in range(steps - 2, -1, -1):
            step = pair + b[t + 1][:, None, :]
            step[:, :, 1] += u[:, t + 1, None]
            b[t] = np.where(mask[:, t + 1, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), b[t + 1])
        z = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
        marginal = np.exp(a[:, :, 1] + b[:, :, 1] - z).T
        grad = np.empty_like(theta)
        miss = np.where(mask, gold - marginal, 0.0) * times[:, None]
        grad[: len(names)] = np.bincount(which, miss.ravel()[where], len(names)) - penalty * w
        grad[len(names)] = miss.sum()
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(a[:-1, :, i] + pair[i, j] + b[1:, :, j] + (u[:, 1:].T if j else 0.0) - z).T
                odd = np.where(both, np.where((g0 == i) & (g1 == j), 1.0, 0.0) - p, 0.0)
                grad[len(names) + 1 + 2 * i + j] = times @ odd.sum(1) - penalty * pair[i, j]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    pair = theta[len(names) + 1 :].reshape(2, 2)
    return Chain(dict(zip(names, theta[: len(names)].tolist(), strict=True)), float(theta[len(names)]), pair.tolist())


def score(docs: DataFrame, chain: Chain, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``carry``, tox_score, and tox_spans: the offending words as
    array of [start, end) in code points."""
    kept = docs.select(*(F.col(c) for c in carry), F.col(text_col).cast("string").alias("tox_text"))
    parts = chain.unary, chain.bias, chain.pair
    added = StructType.fromDDL("tox_score double, tox_spans array<struct<start:bigint,end:bigint>>")
    schema = StructType([*kept.drop("tox_text").schema.fields, *added.fields])

    def run(batches):
        own = Chain(*parts)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            scores, spans = [], []
            for x in batch.column(batch.num_columns - 1):
                s, bad = own.score(x.as_py())
                scores.append(s)
                spans.append([{"start": a, "end": b} for a, b in bad])
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "tox_score", "tox_spans"])

    return kept.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain:
    return fit(training_sample(docs, labels, most))
