"""SimHash near-duplicates: fingerprints of word shingles, linked when few bits
differ, found by an exact comparison of tiles.

Fingerprints that are equal are one node, so a group of copies of any size
costs one comparison.  Nodes are dealt into tiles of neighbouring population
counts.  Two fingerprints within ``radius`` bits have population counts within
``radius``, so only such tile pairs meet, as numpy exclusive-or and bit counts;
no link is missed.  A tile pair reports a spanning forest of its links, never
all its pairs.

``near_copies`` asks for a similarity of the shingle sets instead.  Three bits of
64 find few pairs at 0.8, so it takes 256 bits and a wide radius.  At such a
radius population counts rule out little, but sets of that similarity also have
sizes of that ratio, so its tiles hold neighbouring sizes and meet only those in
reach; tile pairs whose population counts differ beyond the radius are skipped as
well.  The found pairs are held against the sets themselves.

Null, empty and blank texts have no words: fingerprint zero, linked like any
other.  Rows may repeat.  Rows whose id is null take part; the component is the
smallest id that is not null, or null if there is none.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import components, hot_join, local_roots, parallelism, stored

#: Nodes in a tile at most.
TILE = 65_536
#: Hashes that are summed at once, a multiple of 255.
CHUNK = 255 * 256
#: Words of 64 bits in a wide fingerprint, those of them that are compared first, and how often a radius may be exceeded
#: by a pair that has the similarity.
WIDE, FIRST, MISS = 4, 2, 1e-6
#: Shingles from which sets share one radius.
MANY = 64
#: Bytes of shingle sets in a tile that carries them, about.
SET_BYTES = 64 << 20
#: Bands of sizes between two sizes of just the ratio that the similarity allows.
BANDS = 8
#: Words whose hashes a worker remembers.
MEMORY = 400_000
#: Nodes with no id of their own are numbered from here.
NO_ID = 1 << 62


def shingle_hashes(text: bytes | None, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle; ASCII letters are lower-cased, words end at ASCII white space."""
    found = (text or b"").lower().split()
    if not found:
        return []
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


#: A byte's bits, each in a byte of its own: so 255 hashes are summed in eight additions each.
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``sizes`` hashes: a bit is one if it is set in over half of them."""
    sums = np.zeros((len(sizes), 64), np.int64)
    starts = np.cumsum(sizes) - sizes
    cuts = np.union1d(starts[sizes > 0], np.arange(0, len(hashes), 255))
    owner = np.searchsorted(starts, cuts, side="right") - 1  # empty runs stand before the one that starts at the same place
    for at in range(0, len(hashes), CHUNK):
        i, j = np.searchsorted(cuts, (at, at + CHUNK))
        lanes = _SPREAD[hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)]
        part = np.add.reduceat(lanes, cuts[i:j] - at, axis=0).view(np.uint8).reshape(-1, 64)
        np.add.at(sums, owner[i:j], part.astype(np.int64))
    set_bits = (2 * sums > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 512):
                part = [shingle_hashes(x, words, seed) for x in texts.slice(at, 512).to_pylist()]
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                flat = np.fromiter((h for x in part for h in x), np.uint64, int(sizes.sum()))
                fp = majority(flat, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_pairs(x: np.ndarray, y: np.ndarray | None, radius: int):
    """Index pairs within ``radius`` bits, in blocks; with y None within x.  Of fingerprints of several words each is a row."""
    other = x if y is None else y
    rows = max(1, 1_000_000 // max(1, len(other)))
    for at in range(0, len(x), rows):
        right = other[at + 1 :] if y is None else other
        if not len(right):
            continue
        if x.ndim == 1:
            d = np.bitwise_count(x[at : at + rows, None] ^ right[None, :])
        else:
            d = sum(np.bitwise_count(x[at : at + rows, None, k] ^ right[None, :, k]) for k in range(x.shape[1]))
        a, b = np.nonzero(d <= radius)
        yield a + at, (b + at + 1 if y is None else b + len(x))


def _met(nodes: DataFrame, reach: int, room, tiles: int = 48, carried: DataFrame | None = None) -> DataFrame:
    """``nodes`` (with a whole number ``band`` of few values) dealt into tiles of neighbouring bands, and repeated for
    each tile pair (a, b) with bands within ``reach``.  A crowded band has several tiles; ``room`` tells how many nodes of
    a band a tile holds at most.  What is ``carried`` joins by node before rows are repeated."""
    spark = nodes.sparkSession
    counts = sorted((r["band"], r["n"]) for r in nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a band
    share = math.ceil(sum(n for _, n in counts) / tiles)
    dealt, low, high, held = [], [], [], 1 << 62  # (band, first tile, its tiles); bands of each tile
    for band, n in counts:
        size = max(1, min(room(band), share))
        parts = math.ceil(n / size)
        if parts == 1 and held + n <= size:
            high[-1] = band
            held += n
        else:
            held = n if parts == 1 else size
            low += [band] * parts
            high += [band] * parts
        dealt.append((band, len(low) - parts, parts))
    dims = [(t, bisect.bisect_left(high, low[t] - reach), bisect.bisect_right(low, high[t] + reach) - 1) for t in range(len(low))]
    of_band = spark.createDataFrame(dealt, "band int, start long, splits long")
    of_tile = spark.createDataFrame(dims, "tile long, lo long, hi long")  # a row a tile: rows / TILE at most
    placed = nodes.join(F.broadcast(of_band), "band").withColumn("tile", F.col("start") + F.pmod(F.xxhash64("fp", "node"), F.col("splits")))
    placed = placed if carried is None else placed.join(carried, "node")
    met = placed.join(F.broadcast(of_tile), "tile").withColumn("other", F.explode(F.sequence("lo", "hi"))).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    return met.drop("band", "start", "splits", "lo", "hi", "other")


def links(nodes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) that connect all nodes whose fingerprints are within
    ``radius`` bits.  ``nodes``: distinct (node, fp)."""
    met = _met(nodes.select("node", "fp", F.bit_count("fp").alias("band")), radius, lambda _: tile)

    def compare(key, frame):
        fp = frame["fp"].to_numpy().view(np.uint64)
        in_a = frame["tile"].to_numpy() == key[0]
        order = np.concatenate((np.flatnonzero(in_a), np.flatnonzero(~in_a)))
        fp, node, n = fp[order], frame["node"].to_numpy()[order], int(in_a.sum())
        pairs = near_pairs(fp, None, radius) if key[0] == key[1] else near_pairs(fp[:n], fp[n:], radius)
        root = local_roots(len(fp), pairs)
        odd = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"src": node[odd], "dst": node[root[odd]]})

    return met.groupBy("a", "b").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    prints = stored(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("w"))
    nodes = stored(nodes.withColumn("node", F.coalesce("node", F.lit(NO_ID) + F.shiftrightunsigned("fp", 3))), "nodes")
    found = components(links(nodes.select("node", "fp").repartition(parallelism(docs.sparkSession)), radius))
    label = nodes.join(found, "node", "left").select("fp", "w", F.coalesce("component", "node").alias("component_id"))
    label = stored(label.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id"))), "labels")
    return hot_join(prints, label, "fp", "w", prints.count()).select("doc_id", "fp", "component_id")


class _Words(dict):
    """Hashes of words; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: int, known: dict) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending: polynomials in the hashes of their words.  A text of fewer
    words has one shingle, its whole sequence."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return np.unique(mixed(out, 1))


def wide_prints(docs: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """(of, node, fp, print, size) for rows of (of, text): a number of the set of shingles, the first 64 bits of its
    wide fingerprint, that fingerprint, and the number of shingles."""

    def run(batches):
        known = _Words()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 512):
                part = [shingle_set(x, words, known) for x in texts.slice(at, 512).to_pylist()]
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                flat = np.concatenate(part)
                node = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), seed) for x in part), np.uint64, len(part)).view(np.int64)
                wide = np.stack([majority(mixed(flat, k), sizes) for k in range(WIDE)], axis=1)
                prints = pa.array([x.tobytes() for x in wide.astype("<u8")], pa.binary())
                columns = [batch.column(0).slice(at, 512), pa.array(node), pa.array(wide[:, 0].view(np.int64)), prints, pa.array(sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=["of", "node", "fp", "print", "size"])

    of = docs.select("of").schema["of"].dataType.simpleString()
    return docs.select("of", "text").mapInArrow(run, f"of {of}, node long, fp long, print binary, size long")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for rows of (node, text)."""

    def run(batches):
        known = _Words()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 512):
                part = [shingle_set(x, words, known).view(np.int64) for x in texts.slice(at, 512).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in part])))
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(part)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), sets], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of the hashes drawn from each; the first is the hash itself."""
    if not k:
        return hashes
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def differs(shared: int, a: int, b: int) -> float:
    """Probability that a bit differs between the fingerprints of two sets with this many shared elements and ``a`` and
    ``b`` of their own: each element sets it or not by an even chance."""
    n, m = shared + a, shared + b
    above = lambda own, i, size: sum(math.comb(own, j) for j in range(own + 1) if 2 * (i + j) > size) / 2**own
    out = 0.0
    for i in range(shared + 1):
        x, y = above(a, i, n), above(b, i, m)
        out += math.comb(shared, i) / 2**shared * (x * (1 - y) + y * (1 - x))
    return out


@functools.cache
def union_differs(similarity: float, union: int) -> float:
    """The greatest such probability of two sets with this union and at least the similarity."""
    least = math.ceil(similarity * union - 1e-9)
    return max((differs(s, a, union - s - a) for s in range(least, union) for a in range((union - s) // 2 + 1)), default=0.0)


@functools.cache
def radius_for(similarity: float, bits: int, size: int = 1) -> int:
    """Differing bits that a pair of sets with at least this similarity, the larger of ``size`` shingles or more,
    exceeds with a chance of at most MISS."""
    # the probability falls with the size, not evenly, towards that of the angle
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, *(union_differs(similarity, u) for u in range(min(size, MANY), 2 * MANY)))
    more = 0.0
    for r in range(bits, -1, -1):
        more += math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if more > MISS:
            return r
    return 0


def radii(similarity: float) -> tuple[int, np.ndarray]:
    """The radius of the first words for any set, and that of the whole fingerprint by the size of the larger set, up to MANY."""
    return radius_for(similarity, 64 * FIRST), np.array([radius_for(similarity, 64 * WIDE, max(1, k)) for k in range(MANY + 1)])


def nearest_forest(n: int, blocks):
    """Spanning forest of least distances, for nodes 0..n-1.  ``blocks`` yields (a, b, distance); what a block adds is
    folded into the forest before the next."""
    forest = tuple(np.zeros(0, np.int64) for _ in range(3))
    for block in blocks:
        if not len(block[0]):
            continue
        a, b, d = (np.concatenate(x) for x in zip(forest, block, strict=True))
        root, kept = np.arange(n), []
        for level in np.unique(d):
            at = np.flatnonzero(d == level)
            low, high = np.minimum(root[a[at]], root[b[at]]), np.maximum(root[a[at]], root[b[at]])
            at, low, high = at[low != high], low[low != high], high[low != high]
            if not len(at):
                continue
            first = np.unique(low * n + high, return_index=True)[1]
            up: dict[int, int] = {}
            for i, x, y in zip(at[first].tolist(), low[first].tolist(), high[first].tolist(), strict=True):
                while x in up:
                    x = up[x]
                while y in up:
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    kept.append(i)
            moved, to = np.array(list(up)), np.array(list(up.values()))
            step = np.arange(n)
            step[moved] = to
            while not np.array_equal(more := step[step], step):
                step = more
            root = step[root]
        forest = a[kept], b[kept], d[kept]
    return forest


def _wide_pairs(frame: pd.DataFrame, key: tuple, similarity: float, bounds: tuple[int, np.ndarray]):
    """A tile pair's rows in order, tile a first, and blocks (a, b, distance) of its pairs within the radius whose sizes allow the similarity."""
    first, radius = bounds
    in_a = frame["tile"].to_numpy() == key[0]
    order = np.concatenate((np.flatnonzero(in_a), np.flatnonzero(~in_a)))
    wide, n = np.frombuffer(b"".join(frame["print"]), np.uint64).reshape(-1, WIDE)[order], int(in_a.sum())
    size, fp = frame["size"].to_numpy()[order], np.ascontiguousarray(wide[:, :FIRST])
    ones = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)

    def blocks():
        if key[0] != key[1] and (not n or n == len(ones) or ones[:n].min() - ones[n:].max() > first or ones[n:].min() - ones[:n].max() > first):
            return
        for a, b in near_pairs(fp, None, first) if key[0] == key[1] else near_pairs(fp[:n], fp[n:], first):
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            fits = small >= similarity * large
            a, b, large = a[fits], b[fits], large[fits]
            d = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
            near = d <= radius[np.minimum(large, MANY)]
            yield a[near], b[near], d[near]

    return order, blocks()


def _banded(nodes: DataFrame, similarity: float) -> DataFrame:
    """With the band of the set's size.  Sizes of pairs with the similarity are at most BANDS bands apart."""
    band = F.floor(F.log(F.greatest("size", F.lit(1))) * (BANDS / -math.log(similarity - 1e-9)))
    return nodes.withColumn("band", band.cast("int"))


def wide_links(nodes: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Candidate pairs (src, dst) of ``nodes`` (node, fp, print, size): for each tile pair a forest of the nearest."""
    bounds = radii(similarity)

    def compare(key, frame):
        order, blocks = _wide_pairs(frame, key, similarity, bounds)
        node = frame["node"].to_numpy()[order]
        a, b, _ = nearest_forest(len(node), blocks)
        return pd.DataFrame({"src": np.minimum(node[a], node[b]), "dst": np.maximum(node[a], node[b])})

    return _met(_banded(nodes, similarity), BANDS, lambda _: tile).groupBy("a", "b").applyInPandas(compare, "src long, dst long")


def missed_links(nodes: DataFrame, sets: DataFrame, similarity: float, room_bytes: int = SET_BYTES) -> DataFrame:
    """Similar pairs (src, dst) that connect ``nodes`` (node, fp, print, size, component) whose components differ.  Their
    ``sets`` (node, shingles) travel with the tiles, so every pair within the radius is checked where it is found, and
    only links leave."""
    bounds = radii(similarity)
    room = lambda band: max(16, int(room_bytes / 8 * (similarity - 1e-9) ** ((band + 1) / BANDS)))

    def compare(key, frame):
        order, blocks = _wide_pairs(frame, key, similarity, bounds)
        node, group = frame["node"].to_numpy()[order], pd.factorize(frame["component"].to_numpy()[order])[0]
        sets = frame["shingles"].to_numpy()[order]
        src, dst = [], []
        for a, b, d in blocks:
            keep = group[a] != group[b]
            near = np.argsort(d[keep], kind="stable")
            for i, j in zip(a[keep][near].tolist(), b[keep][near].tolist(), strict=True):
                if group[i] == group[j]:
                    continue
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if same >= similarity * (len(sets[i]) + len(sets[j]) - same):
                    src.append(min(node[i], node[j]))
                    dst.append(max(node[i], node[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return _met(_banded(nodes, similarity), BANDS, room, tiles=12, carried=sets.select("node", "shingles")).groupBy("a", "b").applyInPandas(compare, "src long, dst long")


def verified(ends: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs ``ends`` (src, dst) with the similarity of their ``sets`` (node, shingles, w: pairs it is in)."""
    total = max(1, ends.count())
    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name), "w")
    both = hot_join(hot_join(ends, of("src", "x"), "src", "w", total), of("dst", "y"), "dst", "w", total)  # a forest has hubs
    same = F.size(F.array_intersect("x", "y"))
    return stored(both.select("src", "dst", (same / (F.size("x") + F.size("y") - same)).alias("similarity")), "verified")


def copy_groups(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (row, node, of: own_id, the text, and the columns in ``carry``), and for each node (node, w, id, first,
    component): how many rows it has, their smallest id, their first row, and the group it belongs to.

    A node is a set of shingles, never an id, so rows that share an id and differ in their texts are told apart, and
    rows without an id take part.  First is the row with the smallest id; rows without one come last, and a hash of
    what they carry decides between equal ids.

    Candidates are within a radius that a pair with the similarity exceeds with a chance of at most MISS, by the exact
    chances of its sizes; with the bound on the first words, twice MISS at most.  Each tile pair reports a forest of the
    nearest, which is checked against the sets; sets are made of the texts that have a candidate only.  A forest edge
    that fails may stand before one that holds: where checked edges leave several groups of what the candidates connect,
    its nodes are compared again with their sets at hand, every pair between what isn't linked yet being checked.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    held_text = text_col if text_col in carry else "own_text"
    of = F.struct(F.col(id_col).cast("long").alias("own_id"), *([] if text_col in carry else [text.alias("own_text")]), *carry)
    found = wide_prints(docs.select(of.alias("of"), text.alias("text")), words)
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "wide")
    first = F.struct(F.col("of.own_id").isNull().alias("unnamed"), F.col("of.own_id").alias("id"), F.xxhash64("of").alias("hash"), "row")
    nodes = rows.groupBy("node", "fp", "print", "size").agg(F.min("of.own_id").alias("id"), F.min(first).alias("first"), F.count(F.lit(1)).alias("w"))
    nodes = stored(nodes, "nodes")
    points = nodes.select("node", "fp", "print", "size")

    ends = stored(wide_links(points.repartition(parallelism(spark)), similarity).where("src < dst").distinct(), "pairs")
    asked = ends.select(F.col("src").alias("node")).unionByName(ends.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("w"))
    asked = stored(nodes.join(asked.withColumnRenamed("w", "pairs"), "node").select("node", F.col("pairs").alias("w"), F.col("first.row").alias("row")), "asked")
    made = shingle_sets(rows_of(rows, asked.select("row")).select("node", F.col("of")[held_text].alias("text")), words)
    sets = stored(made.join(asked.select("node", "w"), "node"), "sets")
    checked = verified(ends, sets)
    held = checked.where(F.col("similarity") >= similarity).select("src", "dst")
    groups = stored(components(held), "groups")
    around = components(checked).withColumnRenamed("component", "around").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    around = stored(around, "around")
    apart = around.groupBy("around").agg((F.min("component") < F.max("component")).alias("apart")).where("apart")
    doubtful = around.join(apart.select("around"), "around", "left_semi").select("node", "component")
    more = missed_links(stored(points.join(doubtful, "node"), "again"), sets, similarity)
    found = components(held.unionByName(more))

    label = nodes.join(found, "node", "left").select("node", "w", "id", "first", F.coalesce("component", "node").alias("component"))
    return rows.select("row", "node", "of"), stored(label, "labels")


def rows_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose number ``row`` is in ``wanted``.  Numbers are dense in each part, so wanted ones are sent as bits,
    32 768 rows to a map of 4 KB; Spark broadcasts the maps while they are small, and else shuffles by their number."""
    at = F.col("row") + 1  # the functions count from one
    maps = wanted.select(F.bitmap_bucket_number(at).alias("map"), F.bitmap_bit_position(at).alias("bit")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    met = rows.withColumns({"map": F.bitmap_bucket_number(at), "bit": F.bitmap_bit_position(at)}).join(stored(maps, "bits"), "map")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn("byte", byte).where("(shiftright(byte, cast(bit % 8 as int)) & 1) = 1").drop("map", "bit", "bits", "byte")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row: the smallest id reachable over pairs whose sets of shingles have at least
    this Jaccard similarity, null if no row of them has an id."""
    rows, label = copy_groups(docs, words, similarity, id_col, text_col)
    smallest = stored(label.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    named = hot_join(label.select("node", "w", "component"), smallest, "component", "n", label.count())
    out = hot_join(rows.select("node", F.col("of.own_id").alias("doc_id")), stored(named.select("node", "w", "component_id"), "named"), "node", "w", rows.count())
    return out.select("doc_id", "component_id")


def first_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns in ``carry`` of one row of each group of near copies, the first (see ``copy_groups``)."""
    rows, label = copy_groups(docs, words, similarity, id_col, text_col, carry)
    kept = label.groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    return rows_of(rows, kept).select(*(F.col("of")[c].alias(c) for c in carry))
