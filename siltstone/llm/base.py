"""Shared pieces: the shared scratch folder, tables that cut lineage, joins on
skewed keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}

#: A key that holds at least 1/HOT_SHARE of the rows is hot, so there are at
#: most HOT_SHARE of them: a proven bound for broadcasting.
HOT_SHARE = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors
    share; where that setting is missing, below a folder of our own in local mode
    (tests), and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        app = spark.sparkContext.applicationId
        base = _own_folder.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-")
        _own_folder[app] = base
    return f"{base.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and
    a lost executor costs a re-read, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, which has one row for each key and the number
    of left rows with that key in ``weight``.  Hot keys (at most HOT_SHARE, see
    above) are broadcast, so their rows stay where they are; the others, none of
    which holds more than 1/HOT_SHARE of the rows, are shuffled."""
    hot = right.where(F.col(weight) * HOT_SHARE >= F.lit(total)).drop(weight)
    cold = right.where(F.col(weight) * HOT_SHARE < F.lit(total)).drop(weight)
    first = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return first.unionByName(rest)


def hot_anti(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``, which is as for ``hot_join``."""
    hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    return left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot).select(key), key, "left_anti")


def local_roots(n: int, pairs) -> np.ndarray:
    """Smallest index reachable, for nodes 0..n-1.  ``pairs`` yields (a, b) index
    arrays; each array is forgotten once it is merged."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            odd = ra != rb
            if not odd.any():
                break
            a, b, ra, rb = a[odd], b[odd], ra[odd], rb[odd]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list of longs: (node,
    component), the component being its smallest node.  Nodes without an edge
    are not returned.

    Alternating large-star and small-star rounds; every round is written to the
    shared folder.  Stars have hubs, so the joins are those of ``hot_join``.
    """
    e = F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    now = stored(edges.where(F.col(src) != F.col(dst)).select(*e).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("w")), "low")
        large = stored(hot_join(both.where("v > u"), low, "u", "w", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")), "low")
        small = hot_join(large, low, "u", "w", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
