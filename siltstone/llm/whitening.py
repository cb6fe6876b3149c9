"""Whitening of embeddings: covariance by Welford's rank-one updates in each
partition, merged over partitions by the parallel update formula, and its
eigenvectors by the symmetric QR method.

An entry c counts as the long floor(scale * c) + offset.  A partition's moments
leave it as one record for each row of the matrix, so the merge is as parallel
as the vectors are long and streams: a task holds two rows at a time.  The
matrix itself, which doesn't grow with the table, is solved in one task.

Vectors that are null or hold null or non-finite entries are left out.  Vectors
of one length are one fit list: other lengths have models of their own, and
empty vectors have no component and no row.  Rows may repeat, and ids may be
null or repeat: every row counts and is returned.  A component without variance
(a constant table, fewer vectors than components) has null as its whitened
value, is left out of ``identity_error``, and where no component has any,
``explained`` and ``identity_error`` are null.  ``deviation`` is exact; beyond
a long it is null.  Other columns are ignored; an empty table gives an empty
result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import hot_join, stored

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Numbers that the moments of a partition hold before they are handed on, about (64 MB); one length is always held whole.
HELD = 1 << 23

MOMENTS = "list int, row int, n long, total decimal(38,0), mean array<double>, scatter array<double>"


class Moments:
    """Count, mean and scatter (sum of products of deviations) of vectors, updated by one at a time, and the exact sum of whole ones."""

    def __init__(self, length: int):
        self.n, self.mean, self.scatter, self._room = 0, np.zeros(length), np.zeros((length, length)), np.empty((length, length))
        self.total = [0] * length

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        gap = x - self.mean
        self.mean += gap / self.n
        np.multiply.outer(gap, gap * ((self.n - 1) / self.n), out=self._room)
        self.scatter += self._room

    def add_total(self, rows: np.ndarray) -> None:
        sums = rows.astype(object).sum(0) if np.abs(rows).max() > 1 << 40 else rows.sum(0)
        self.total = [a + int(b) for a, b in zip(self.total, sums, strict=True)]


def merged(a: tuple, b: tuple, row: int) -> tuple:
    """Row ``row`` of two lists' moments as one: (n, total, mean, scatter row)."""
    n = a[0] + b[0]
    gap = b[2] - a[2]
    return n, a[1] + b[1], a[2] + gap * (b[0] / n), a[3] + b[3] + gap * (gap[row] * (a[0] * b[0] / n))


def _records(parts) -> pa.RecordBatch:
    cols = list(zip(*parts, strict=True)) or [()] * 6
    types = pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in MOMENTS.replace("38,0", "38").split(", ")])


def moments(vectors: DataFrame, whole: bool) -> DataFrame:
    """MOMENTS over ``list`` and ``x``: a record for each list and row of its matrix.  The vectors of a list have one
    length.  With ``whole`` the entries are longs and summed as such."""

    def leave(held):
        for k, m in held.items():
            yield _records([(k, i, m.n, m.total[i], m.mean, m.scatter[i]) for i in range(len(m.mean))])

    def run(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            lists, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, starts = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            for k in np.unique(lists):
                at = np.flatnonzero(lists == k)
                length = int(starts[at[0] + 1] - starts[at[0]])
                if not length:
                    continue
                if k not in held:
                    if sum(len(m.mean) ** 2 for m in held.values()) + length**2 > HELD:
                        yield from leave(held)
                        held.clear()
                    held[int(k)] = Moments(length)
                rows = flat[starts[at][:, None] + np.arange(length)]
                if whole:
                    held[k].add_total(rows)
                for x in rows.astype(float):
                    held[k].add(x)
        yield from leave(held)

    def merge(key, batches):
        row, out = key[1].as_py(), None
        for batch in batches:
            n, total = batch.column("n").to_pylist(), batch.column("total").to_pylist()
            for i in range(batch.num_rows):
                one = n[i], int(total[i]), batch.column("mean")[i].values.to_numpy(), batch.column("scatter")[i].values.to_numpy()
                out = one if out is None else merged(out, one, row)
        yield _records([(key[0].as_py(), row, *out)])

    return vectors.select("list", "x").mapInArrow(run, MOMENTS).groupBy("list", "row").applyInArrow(_typed(merge), MOMENTS)


def _typed(f):
    """``f`` with the annotations by which Spark knows the streaming form."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(key, batches)

    return merge


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and q (rows) with a = q.T t q, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0.0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        for m in (a, a.T):  # from the left, then from the right
            m[k + 1 :] -= 2.0 * np.outer(v, v @ m[k + 1 :])
        q[k + 1 :] -= 2.0 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (rows; the largest entry of each is positive): implicit QR steps with
    Wilkinson's shift on the tridiagonal form."""
    n = len(a)
    d, e, q = tridiagonal(a)
    small = np.finfo(float).eps
    end, left = n - 1, 60 * n + 60
    while end > 0:
        e[:end][np.abs(e[:end]) <= small * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))] = 0.0
        if e[end - 1] == 0.0:
            end -= 1
            continue
        left -= 1
        if not left:
            raise ArithmeticError("the QR iteration does not settle")
        start = end - 1
        while start > 0 and e[start - 1] != 0.0:
            start -= 1
        half = (d[end - 1] - d[end]) / 2.0
        root = np.hypot(half, e[end - 1])
        x, z = d[start] - d[end] + e[end - 1] ** 2 / (half + (root if half >= 0 else -root)), e[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            p, o, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * o
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    return d, q * np.sign(q[np.arange(n), np.abs(q).argmax(1)])[:, None]


MODEL = "list int, n long, total array<long>, axes array<array<double>>, deviations array<double>, explained array<double>"
_MODEL = {"list": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.int64()), "axes": pa.list_(pa.list_(pa.float64())), "deviations": pa.list_(pa.float64()), "explained": pa.list_(pa.float64())}


def _matrix(table: pa.Table) -> np.ndarray:
    v = np.array(table.sort_by("row")["scatter"].to_pylist()) / table["n"][0].as_py()
    return (v + v.T) / 2


def models(found: DataFrame, most: int) -> DataFrame:
    """MODEL from MOMENTS: a row a list.  ``deviations``: roots of the eigenvalues that are not zero."""

    def solve(table: pa.Table) -> pa.Table:
        v = _matrix(table)
        value, vector = symmetric_qr(v)
        k, trace = min(most, len(v)), float(np.trace(v))
        real = int((value[:k] > len(v) * np.finfo(float).eps * max(value[0], 0.0)).sum())
        share = [float(x) / trace for x in value[:k]] if trace > 0 else [None] * k
        totals = [int(x) for x in table.sort_by("row")["total"].to_pylist()]
        row = {"list": table["list"][0].as_py(), "n": table["n"][0].as_py(), "total": totals, "axes": vector[:k].tolist(), "deviations": np.sqrt(value[:real]).tolist(), "explained": share}
        return pa.table({c: pa.array([row[c]], t) for c, t in _MODEL.items()})

    return found.groupBy("list").applyInArrow(solve, MODEL)


def identity_errors(found: DataFrame) -> DataFrame:
    """list, identity_error from MOMENTS: the largest entry by which a list's covariance differs from the identity."""

    def solve(table: pa.Table) -> pa.Table:
        v = _matrix(table)
        return pa.table({"list": table["list"][:1].combine_chunks(), "identity_error": [float(np.abs(v - np.eye(len(v))).max())]})

    return found.groupBy("list").applyInArrow(solve, "list int, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    raw = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("v")).where(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(offset).cast("long"))
    longs = stored(usable.select("vec_id", F.size("v").alias("list"), x.alias("x")), "whole-vectors")
    model = stored(models(moments(longs, True), most).withColumn("w", F.col("n")), "whitening")
    total = longs.count()

    gaps = F.zip_with("x", "total", lambda a, s: F.col("n") * a - s)
    square = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: F.try_add(a, F.try_multiply(g, g)))
    along = lambda axis: F.aggregate(F.zip_with("gaps", axis, lambda g, a: g.cast("double") / F.col("n") * a), F.lit(0.0), lambda s, y: s + y)
    white = F.zip_with(F.slice("axes", F.lit(1), F.size("deviations")), "deviations", lambda axis, d: along(axis) / d)
    met = hot_join(longs, model.select("list", "n", "total", "axes", "deviations", "w"), "list", "w", total)
    rows = stored(met.withColumn("gaps", gaps).select("vec_id", "list", square.alias("deviation"), white.alias("x")), "whitened")

    said = model.join(identity_errors(moments(rows, False)), "list", "left").select("list", "n", "w", "explained", "identity_error")
    spread = hot_join(rows, said, "list", "w", total).select("vec_id", "n", "deviation", "x", "identity_error", F.posexplode("explained").alias("at", "share"))
    return spread.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.get("x", F.col("at")).alias("whitened"), F.col("share").alias("explained"), "identity_error")
