"""Line diffs of pairs of texts: the longest common lines, each pair in the row where it lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a pair's table, at most; larger pairs are all removed and all added (fixed value).
CELLS = 4_000_000


def diff(before: str, after: str, cells: int = CELLS) -> list[tuple[str, str]]:
    """(op, line): same, del or add.  Where both would do, a line goes before one comes."""
    a, b = (x.split("\n") if x else [] for x in (before, after))
    if len(a) * len(b) > cells:
        return [("del", x) for x in a] + [("add", x) for x in b]
    number = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[s] for s in side], np.int32) for side in (a, b))
    common = np.zeros((len(a) + 1, len(b) + 1), np.int32)  # of what follows
    for i in range(len(a) - 1, -1, -1):
        best = np.where(y == x[i], common[i + 1, 1:] + 1, common[i + 1, :-1])
        common[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if x[i] == y[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif common[i + 1, j] >= common[i, j + 1]:
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out + [("del", s) for s in a[i:]] + [("add", s) for s in b[j:]]


def line_diffs(pairs: DataFrame, key: str, before: str, after: str, cells: int = CELLS) -> DataFrame:
    """key, n, op, line: the lines of each pair's diff, n from 0.  Null texts are empty; pairs without lines have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a batch a pair, so that long diffs don't add up
                k, a, b = (c[row].as_py() for c in batch.columns)
                found = diff(a, b, cells)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int32()), pa.array([op for op, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], names=[key, "n", "op", "line"])

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, F.coalesce(before, F.lit("")).alias("a"), F.coalesce(after, F.lit("")).alias("b")).mapInArrow(run, f"`{key}` {kind}, n int, op string, line string")
