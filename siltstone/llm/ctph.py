"""Context-triggered piecewise hashing: fingerprints that stay alike where texts do.

A rolling hash of seven bytes ends a chunk wherever it falls on a multiple of
the block size; each chunk gives one letter.  A fingerprint is
``size:letters:letters``, the second part at twice the size, so fingerprints
whose sizes are equal or a factor of two apart compare: by the edit distance of
their letters (a replacement counts as one removal and one insertion), and only
if they share a run of letters.

Null and empty texts have the fingerprint ``3::``; equal fingerprints are
wholly alike.  Rows with equal ids follow each other in the order of a hash of
their texts, null ids come first.  Other columns are ignored; an empty table gives an
empty result, and a single row is its own successor.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import parallelism

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
SMALLEST, LETTERS, WINDOW = 3, 64, 7
#: Letters in a run that two fingerprints must share.
RUN = 7
_P = 0x9E3779B97F4A7C15
_BACK = pow(_P, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = 1 << max(16, n.bit_length())
        _powers, _inverse = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, x, np.uint64)))) for x in (_P, _BACK))


def _rolling(b: np.ndarray) -> np.ndarray:
    """At each byte a mix of the last WINDOW bytes, which is all it depends on."""
    c = np.concatenate((np.zeros(WINDOW - 1, np.uint32), b.astype(np.uint32)))
    out = np.zeros(len(b), np.uint32)
    for i in range(WINDOW):
        out = out * np.uint32(0x01000193) + (c[i : i + len(b)] + np.uint32(1))
    return (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def _letters(sums: np.ndarray, ends: np.ndarray, n: int, most: int) -> str:
    """A letter for each chunk; beyond ``most`` chunks the last letter stands for the rest."""
    stops = np.append(ends, n) if not len(ends) or ends[-1] != n else ends
    if len(stops) > most:
        stops = np.append(stops[: most - 1], n)
    starts = np.concatenate(([0], stops[:-1]))
    h = (sums[stops] - sums[starts]) * _inverse[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    _grow(n)
    b = np.frombuffer(data, np.uint8)
    rolled = _rolling(b)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[:n])))
    size = SMALLEST
    while size * LETTERS < n:
        size *= 2
    found: dict[int, np.ndarray] = {}

    def ends(size: int) -> np.ndarray:
        # a multiple of twice the size is one of the size itself, so larger sizes look at few places
        if size not in found:
            at = next((found[s] for s in sorted(found, reverse=True) if size % s == 0), None)
            found[size] = np.flatnonzero(rolled % np.uint32(size) == 0) + 1 if at is None else at[rolled[at - 1] % np.uint32(size) == 0]
        return found[size]

    while size > SMALLEST and len(ends(size)) < LETTERS // 2:
        size //= 2
    return f"{size}:{_letters(sums, ends(size), n, LETTERS)}:{_letters(sums, ends(2 * size), n, LETTERS // 2)}"


def _squeezed(s: str) -> str:
    """Runs of one letter say little; three of a run stay."""
    return re.sub(r"(.)\1{3,}", r"\1\1\1", s)


def edit_distance(a: str, b: str) -> int:
    """Least removals and insertions that turn a into b, by a bit-parallel longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _alike(a: str, b: str) -> float:
    short = _squeezed(a), _squeezed(b)
    if min(map(len, short)) >= RUN:  # else the texts are little but repetition
        a, b = short
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    k = min(RUN, len(a), len(b))
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not any(b[i : i + k] in runs for i in range(len(b) - k + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 where the block sizes don't compare."""
    if x == y:
        return 1.0
    (m, a1, a2), (n, b1, b2) = x.split(":"), y.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2))
    if m == 2 * n:
        return _alike(a1, b2)
    return _alike(a2, b1) if n == 2 * m else 0.0


def _cuts(base: DataFrame, n: int) -> list[tuple[int, int | None]]:
    """Places that part the rows (at, h) into n ranges, about: ids, and hashes within an id that has several ranges to
    itself.  A place that comes twice is that of rows which are alike."""
    ids = base.select(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    ids = Counter(ids or [])
    hot = {a: k for a, k in ids.items() if k > 1}  # fewer than n
    out: list[tuple[int, int | None]] = [(a, None) for a in ids]
    if hot:
        most = max(hot.values())
        inside = base.where(F.col("at").isin(list(hot))).groupBy("at").agg(F.percentile_approx("h", [i / (4 * most) for i in range(1, 4 * most)], 100 * n).alias("h")).collect()
        for r in inside:
            step = 4 * most // hot[r["at"]]
            out += [(r["at"], h) for h in r["h"][step - 1 :: step]]
    return sorted(out, key=lambda c: (c[0], c[1] is None, c[1] or 0))


def with_next(docs: DataFrame, run, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``run`` to pairs of neighbours in ascending order of id.

    Rows are dealt into ranges of ids, and of hashes of texts where an id fills
    several ranges.  The first row of a range also goes to the
    range before it, and the very first to the last, so every pair meets in one
    task.  ``run`` takes an iterator of ((id, text), (id, text)) and yields
    record batches."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.select(F.coalesce("id", F.lit(-(1 << 63))).alias("at"), F.xxhash64("text").alias("h"), "id", "text")
    n = 2 * parallelism(spark)
    row = F.struct("at", "h")
    cuts = _cuts(base, n)
    # rows above a cut are in a later range; a cut without a hash stands behind all rows of its id
    known = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(h).cast("long").alias("h")) for a, h in cuts)) if cuts else F.array().cast("array<struct<at:bigint,h:bigint>>")
    bucket = F.size(F.filter(known, lambda c: (c["at"] < F.col("at")) | ((c["at"] == F.col("at")) & (c["h"] < F.col("h")))))
    # rows alike, where they fill several ranges: dealt by the part that they come from
    alike = Counter(c for c in cuts if c[1] is not None)
    salt = F.lit(0)
    for (at, h), times in alike.items():
        if times > 1:
            salt = F.when((F.col("at") == at) & (F.col("h") == h), F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(times)).cast("int")).otherwise(salt)
    placed = base.withColumn("bucket", bucket + salt)
    heads = [(r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min(row).alias("first")).orderBy("bucket").collect()]  # a row a range
    if not heads:
        return spark.createDataFrame([], schema)
    # the rows that begin a range, few as they are alike, also go to the range before it
    firsts = spark.createDataFrame([(b, f["at"], f["h"], heads[i - 1][0]) for i, (b, f) in enumerate(heads)], "bucket int, at long, h long, edge int")
    own = placed.select("bucket", F.lit(0).alias("copy"), "id", "text", "h")
    copies = placed.join(F.broadcast(firsts), ["bucket", "at", "h"]).select(F.col("edge").alias("bucket"), F.lit(1).alias("copy"), "id", "text", "h")
    rows = own.unionByName(copies).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "copy", F.col("id").asc_nulls_first(), "h", "text").drop("h")

    def pairs(batches):
        last = None  # bucket, copy, (id, text)
        for batch in batches:
            for b, copy, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last and last[0] == b and not last[1]:
                    yield last[2], (id_, text)
                last = b, copy, (id_, text)

    return rows.mapInArrow(lambda batches: run(pairs(batches)), schema)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for each row: fingerprints of the text and of its edit, whose last
    half is replaced by as much of the next document's start."""

    def run(pairs):
        rows, known = [], (None, "")
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for (id_, text), (_, after) in pairs:
            own = known[1] if known[0] is text else fingerprint(text.encode())
            follows = fingerprint(after.encode())
            known = after, follows
            half = len(text) // 2
            edited = (text[: len(text) - half] + after[:half]).encode()
            other = fingerprint(edited)
            rows.append((id_, len(text), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, follows)))
            if len(rows) == 2000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return with_next(docs, run, SCHEMA, id_col, text_col)
