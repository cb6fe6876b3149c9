"""Removal of long passages that repeat across documents, by suffix arrays of
document collections built column by column.

A window is ``length`` bytes.  Equal windows have the same anchor: the k-gram in
them with the smallest hash, the leftmost of equal ones.  Neighbouring windows
with one anchor make a fragment, and fragments whose anchor no other document
has are done with.  All others go to the anchor's bucket.  There the fragments
of the anchors that differ form collections: the Burrows-Wheeler transform and
longest common prefixes of a collection grow by one symbol of each fragment a
round, in sequential files with a segment for each first symbol.  Where common
prefixes reach ``length`` bytes, windows are equal; all but those of the
smallest id are removed.  A column-wise build of whole texts would take as many
rounds as the longest text has bytes; fragments have at most 2 * length - k.

Repeats are folded before every shuffle.  Rows that repeat id and text are one
while the work goes on and get its result back at the end.  A text of which a
smaller id has a copy, by 128 bits of hash, is removed whole without a look at
its bytes; a block of documents sends an anchor once, and of equal
fragments only that of the smallest id.  Where HOT fragments or more have one
anchor, as at the edges of a passage that a third of all documents have, each
window is a fragment with its own hash for an anchor, so they spread.

Null texts are empty.  A null id is larger than all others.  Rows with equal ids
don't remove each other's bytes; a row that repeats id and text is treated
alike.  Texts of any length are taken whole, in overlapping pieces of 1 MiB.
Other columns are ignored, whatever they are called; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import HOT_SHARE, hot_anti, hot_join, parallelism, stored

#: Bytes of an anchor, and of text that is looked at together (its places take PLACE bits).
GRAM, PLACE = 24, 20
#: Bytes of text in a block, about.
BLOCK = 16 << 20
#: Fragments in a collection, but for those of one anchor, of which there are HOT at most: where that many fragments have
#: an anchor, their windows go their own ways.
COLLECTION, HOT = 32_768, 4096
#: Symbols of a collection that are read together, about: segments smaller than that come with their neighbours.
TOGETHER = 1 << 18
_P = 0x9E3779B97F4A7C15
_SIZE = 1 << PLACE
_powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(_SIZE, _P, np.uint64))))
_inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(_SIZE, pow(_P, -1, 1 << 64), np.uint64))))
NO_ID = (1 << 63) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(texts: list[bytes], length: int):
    """Texts put together up to _SIZE bytes: (bytes, text numbers, offsets in the
    text, starts, ends).  A longer text comes in pieces that overlap by length - 1."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        at = 0
        while True:
            part = t[at : at + _SIZE]
            if size + len(part) > _SIZE:
                yield _joined(group)
                group, size = [], 0
            group.append((part, i, at))
            size += len(part)
            if at + _SIZE >= len(t):
                break
            at += _SIZE - length + 1
    if group:
        yield _joined(group)


def _joined(group):
    sizes = np.array([len(p) for p, _, _ in group])
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(p for p, _, _ in group), np.uint8), np.array([i for _, i, _ in group]), np.array([a for _, _, a in group]), ends - sizes, ends


def fragments(texts: list[bytes], length: int, gram: int = GRAM):
    """Arrays (anchor hash, text number, first byte, bytes) of all fragments of the texts."""
    out = []
    for data, which, offset, starts, ends in _pieces(texts, length):
        n = len(data)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[:n])))
        h = _mixed((sums[gram:] - sums[:-gram]) * _inverse[: n - gram + 1])
        low = np.uint64(_SIZE - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have, want = 1, length - gram + 1
        while 2 * have <= want:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < want:
            least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
        valid = np.zeros(len(least) + 1, bool)
        for a, b in zip(starts.tolist(), (ends - length + 1).tolist(), strict=True):
            valid[a:b] = True
        valid = valid[: len(least)]
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])))
        new[starts[starts < len(new)]] = True
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(least)]))
        keep = valid[first]
        first, last = first[keep], last[keep]
        seg = np.searchsorted(ends, first, side="right")
        out.append((_mixed(least[first] >> np.uint64(PLACE)), which[seg], first - starts[seg] + offset[seg], last - first + length - 1))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the lower half of the hash: what an anchor is known by across tasks."""
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


class Columns:
    """Two columns of a collection, its transform and its common prefixes, as sequential files with a segment for each
    first symbol.  A round reads the segments in order and writes their successors in order; neighbouring segments come
    together while they have few symbols.  A collection is bounded, so the files are kept in memory: a cluster's machines
    share no folder that a task could open."""

    def __init__(self, segments: int, wide, deep):
        self.kinds = (np.dtype(wide), np.dtype(deep))
        self.sizes = np.zeros(segments, np.int64)
        self.files = (io.BytesIO(), io.BytesIO())

    def read(self, together: int = TOGETHER):
        """(first segment, the one behind the last, transform, common prefixes) of runs of segments, in sequence."""
        for f in self.files:
            f.seek(0)
        first, n = 0, 0
        for c, size in enumerate(self.sizes.tolist(), 1):
            n += size
            if n >= together or c == len(self.sizes):
                yield first, c, *(np.frombuffer(f.read(n * k.itemsize), k) for f, k in zip(self.files, self.kinds, strict=True))
                first, n = c, 0

    def replaced(self, runs, sizes: np.ndarray) -> None:
        """Write runs of segments (transform, common prefixes), in order, in place of the old ones; ``sizes`` by segment."""
        fresh = (io.BytesIO(), io.BytesIO())
        for columns in runs:
            for f, k, column in zip(fresh, self.kinds, columns, strict=True):
                f.write(column.astype(k, copy=False).tobytes())
        self.files, self.sizes = fresh, sizes


def collection(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and longest common prefixes of all suffixes of the texts.  The bytes in use are
    numbered from 1; 0 stands before a text's first symbol.  Segment 0 holds the ends in the order of the texts,
    segment c the suffixes that start with c.

    Round 0 inserts the ends, round j the suffix of j symbols of every text that long.  Where the symbol before a
    text's latest suffix is c, the new suffix goes to segment c, to the place that the rank of that c in the
    transform gives.  Its common prefix with its neighbour is one more than the least between the two suffixes that
    they extend; a segment's first suffix has none, so that is one where these start with different symbols."""
    used = sorted({b for t in texts for b in t})
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    wide = np.uint16 if len(used) > 255 else np.uint8
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    flat = code[np.frombuffer(b"".join(texts), np.uint8)].astype(wide)
    m, kinds, longest = len(texts), len(used) + 1, int(sizes.max())

    def before(who: np.ndarray, size: int) -> np.ndarray:
        """The symbol before the suffix of ``size`` symbols; 0 where the text begins."""
        at = np.maximum(ends[who] - size - 1, 0)
        return np.where(sizes[who] > size, flat[at], 0).astype(wide)

    files = Columns(kinds, wide, np.min_scalar_type(longest))
    live = np.arange(m)
    files.replaced([(before(live, 0), np.zeros(m))], np.array([m, *[0] * (kinds - 1)]))
    segment, place = np.zeros(m, np.int64), np.arange(m)  # of each live text's latest suffix, ascending
    for size in range(1, longest + 1):
        seen = np.zeros(kinds, np.int64)  # of each symbol, in the segments read so far
        fresh = []  # (text, symbol, place, common prefix)
        changed = []  # (symbol, place, common prefix) where a new suffix in front changes it
        starts_at = np.cumsum(files.sizes) - files.sizes
        pending = np.zeros(kinds, bool)  # symbols whose next suffix follows a new one of an earlier run
        for first, behind, bwt, lcp in files.read():
            if not len(bwt):
                continue
            counts = np.bincount(bwt, minlength=kinds)
            starts = np.cumsum(counts) - counts
            order = np.argsort(bwt, kind="stable")
            # the first of its symbol here shares that symbol with the last one of an earlier run
            late = np.flatnonzero(pending & (counts > 0))
            late = late[late > 0]
            changed.append((late, seen[late], np.ones(len(late), np.int64)))
            pending[counts > 0] = False
            mine = slice(*np.searchsorted(segment, (first, behind)))
            who, at = live[mine], place[mine] + starts_at[segment[mine]] - starts_at[first]
            if len(who):
                symbol = bwt[at].astype(np.int64)
                turn = np.empty(len(order), np.int64)
                turn[order] = np.arange(len(order))
                t = turn[at]
                rank = t - starts[symbol]
                padded = np.append(lcp, lcp[-1:])
                follows = np.flatnonzero(rank > 0)
                common = np.where(seen[symbol] > 0, 1, 0)
                common[follows] = 1 + _least(padded, order[t[follows] - 1], at[follows])
                fresh.append((who, symbol, seen[symbol] + rank, common))
                leads = np.flatnonzero((rank + 1 < counts[symbol]) & (symbol > 0))
                changed.append((symbol[leads], seen[symbol[leads]] + rank[leads] + 1, 1 + _least(padded, at[leads], order[t[leads] + 1])))
                pending[symbol[rank + 1 == counts[symbol]]] = True
            seen += counts
        who, symbol, at, common = (np.concatenate(x) for x in zip(*fresh, strict=True))
        keep = np.flatnonzero(symbol > 0)
        keep = keep[np.argsort((symbol[keep] << 40) | at[keep])]
        live, segment, place, common = who[keep], symbol[keep], at[keep], common[keep]
        added = before(live, size)
        of, where, value = (np.concatenate(x) for x in zip(*changed, strict=True))
        by = np.argsort(of, kind="stable")
        of, where, value = of[by], where[by], value[by]
        grown_sizes = files.sizes + np.bincount(segment, minlength=kinds)
        grown_at = np.cumsum(grown_sizes) - grown_sizes

        def grown():
            for first, behind, bwt, lcp in files.read():
                mine, theirs = (slice(*np.searchsorted(x, (first, behind))) for x in (segment, of))
                here = place[mine] + grown_at[segment[mine]] - grown_at[first]
                total = len(bwt) + len(here)
                old = np.ones(total, bool)
                old[here] = False
                wider, deeper = np.empty(total, bwt.dtype), np.empty(total, lcp.dtype)
                wider[old], wider[here] = bwt, added[mine]
                deeper[old] = lcp
                deeper[where[theirs] + grown_at[of[theirs]] - grown_at[first]] = value[theirs]
                deeper[here] = common[mine]
                yield wider, deeper

        files.replaced(list(grown()), grown_sizes)
    columns = list(files.read())
    return np.concatenate([x for *_, x, _ in columns]), np.concatenate([x for *_, x in columns])


def _bounds(ordered: np.ndarray):
    """Starts and ends of the runs of equal values."""
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(ordered)]
    return start, np.append(start[1:], len(ordered))[: len(start)]


def _least(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the common prefixes behind a, up to b.  ``padded`` has one element more than there are."""
    if not len(a):
        return np.zeros(0, np.int64)
    spans = np.stack((a + 1, b + 1), axis=1).ravel()
    return np.minimum.reduceat(padded, spans)[::2].astype(np.int64)


def first_owners(texts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text and each window in it the smallest owner of a text that holds the window."""
    bwt, lcp = collection(texts)
    sizes = np.array([len(t) for t in texts])
    # back through the transform from the ends, all texts at a time: whose suffix stands where, and how long it is
    order = np.argsort(bwt, kind="stable")
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    who, size = np.zeros(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    live = np.arange(len(texts))
    who[: len(texts)] = at = live
    for k in range(1, int(sizes.max()) + 1):
        keep = sizes[live] >= k
        live, at = live[keep], turn[at[keep]]
        who[at], size[at] = live, k
    starts = np.flatnonzero(np.concatenate(([True], lcp[1:] < length)))
    least = np.repeat(np.minimum.reduceat(owners[who], starts), np.diff(np.append(starts, len(who))))
    full = np.flatnonzero(size >= length)
    first = np.concatenate(([0], np.cumsum(sizes - length + 1)))
    out = np.full(first[-1], NO_ID, np.int64)
    out[first[who[full]] + sizes[who[full]] - size[full]] = least[full]
    return np.split(out, first[1:-1])


def _runs(hit: np.ndarray, length: int):
    """[start, end) of the bytes that the marked windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) + length - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


FOUND = "bucket long, block long, n long, payload binary"
_MARK = np.dtype([("row", "<u4"), ("start", "<i8"), ("end", "<i8")])
#: A payload's columns for fragments: anchor, id, row of the block, first byte, bytes; the fragments' bytes follow.
_COLUMNS = ("<u8", "<i8", "<u4", "<i8", "<u2")


def _rows(frame: pd.DataFrame) -> tuple[list[int], list[bytes], list[int]]:
    """Ids, texts and row numbers of a block's documents.  Numbers follow from the ids
    and texts alone, so every stage gives a document the same one."""
    ids = [NO_ID if pd.isna(i) else int(i) for i in frame["id"].tolist()]
    keys = list(zip(ids, frame["tid"].tolist(), strict=True))
    number = {k: n for n, k in enumerate(sorted(set(keys)))}
    return ids, frame["text"].tolist(), [number[k] for k in keys]


def _without_copies(frame: pd.DataFrame, said: pd.DataFrame) -> tuple[list[int], list[bytes], list[int], list[int]]:
    """As _rows, by id; texts of which a smaller id has a copy are left out, and their places listed."""
    frame = frame.sort_values(["id", "tid"], na_position="last")
    ids, texts, rows = _rows(frame)
    copies = {bytes(x) for x in said.loc[said["bucket"] < 0, "payload"]}
    names = [int(i).to_bytes(8, "big") + (t & (1 << 64) - 1).to_bytes(8, "big") for i, t in zip(ids, frame["tid"].tolist(), strict=True)]
    gone = [k for k, name in enumerate(names) if name in copies]
    for k in gone:
        texts[k] = b""
    return ids, texts, rows, gone


def removed(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    base = base.withColumn("tid", F.xxhash64("text")).withColumn("said", F.concat_ws(":", F.coalesce("id", F.lit(NO_ID)), "tid", F.xxhash64(F.lit(1), "text")))
    rows = stored(base.groupBy("said").agg(F.count(F.lit(1)).alias("w"), F.sum(F.octet_length("text")).alias("bytes")), "rows")
    n, total = rows.agg(F.sum("w"), F.sum("bytes")).first()
    twice = stored(rows.where("w > 1").select("said", "w"), "repeated")
    if not twice.limit(1).count():
        return _removed(base, total or 0, length, block_bytes, hot).select(*RESULT)
    one = hot_join(base, twice, "said", "w", n).groupBy("id", "tid", "said").agg(F.max("text").alias("text"))
    once = stored(hot_anti(base, twice, "said", "w", n).unionByName(one), "once")
    found = stored(_removed(once, total, length, block_bytes, hot), "removed")
    many = base.select("said").join(F.broadcast(twice.where(F.col("w") * HOT_SHARE >= n)), "said", "left_semi")
    some = base.select("said").join(twice.where(F.col("w") * HOT_SHARE < n), "said", "left_semi")
    back = hot_join(many.unionByName(some), found.join(twice, "said"), "said", "w", n)
    return found.join(twice, "said", "left_anti").select(*RESULT).unionByName(back.select(*RESULT))


RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _removed(base: DataFrame, total: int, length: int, block_bytes: int, hot: int) -> DataFrame:
    """RESULT and ``said`` for rows of id, text, tid and said, none of which repeats another."""
    blocks = max(parallelism(base.sparkSession), math.ceil(total / block_bytes))  # and as many buckets
    placed = base.withColumn("block", F.pmod(F.xxhash64("id", "tid"), F.lit(blocks)))

    # whole texts that a smaller id has too: known by 128 bits of hash, removed whole
    name = F.concat_ws(":", "tid", F.xxhash64(F.lit(1), "text"))
    names = stored(placed.select("block", F.coalesce("id", F.lit(NO_ID)).alias("id"), "tid", name.alias("name")), "texts")
    first = stored(names.groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("w")).where("w > 1"), "copies")
    packed = F.unhex(F.concat(F.lpad(F.hex("id"), 16, "0"), F.lpad(F.hex("tid"), 16, "0")))
    copies = hot_join(names, first, "name", "w", max(1, names.count())).where("id > first")
    copies = stored(copies.select(F.lit(-1).cast("long").alias("bucket"), "block", F.lit(0).cast("long").alias("n"), packed.alias("payload")), "copies")

    def anchors(key, frame, said):
        """A block's anchors by bucket, each once, with the number of its fragments; one more where they are of two rows."""
        _, texts, _, _ = _without_copies(frame, said)
        h, which, _, _ = fragments(texts, length)
        if not len(h):
            return pd.DataFrame({"bucket": [], "block": [], "n": [], "payload": []})
        known = _key(h, blocks)
        order = np.lexsort((which, known))
        known, which = known[order], which[order]
        start, end = _bounds(known)
        many = np.where(which[start] != which[end - 1], np.minimum(end - start, 0xFFFF), 1).astype(np.uint16)
        known = known[start]
        bucket = (known >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        low = known.astype(np.uint32)
        rows = [(int(bucket[i]), key[0], int(j - i), low[i:j].tobytes() + many[i:j].tobytes()) for i, j in zip(cut, np.append(cut[1:], len(known)), strict=True)]
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "payload"])

    def shared(key, frame):
        """The anchors that two documents have, for each block that has them; those that very many fragments have with
        a mark (in n of a row of its own, below zero)."""
        low = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(frame["payload"], frame["n"], strict=True)])
        blk = np.repeat(frame["block"].to_numpy(), frame["n"].to_numpy())
        many = np.concatenate([np.frombuffer(x, np.uint16, n, 4 * n) for x, n in zip(frame["payload"], frame["n"], strict=True)])
        order = np.argsort(low, kind="stable")
        low, blk, many = low[order], blk[order], many[order].astype(np.int64)
        start, end = _bounds(low)
        count = np.add.reduceat(many, start)
        keep, many = (np.repeat(x, end - start) for x in (count > 1, count >= hot))
        rows = []
        for sign, which in ((1, keep & ~many), (-1, keep & many)):
            here, of = low[which], blk[which]
            by = np.argsort(of, kind="stable")
            here, of = here[by], of[by]
            rows += [(key[0], int(of[i]), int(sign * (j - i)), here[i:j].tobytes()) for i, j in zip(*_bounds(of), strict=True)]
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "payload"])

    def candidates(key, frame, said):
        """Fragments of a block's documents whose anchors are shared; of equal ones that of the smallest id, for the
        others a mark.  Where very many fragments have an anchor, each of their windows is a fragment, and its hash the anchor."""
        ids, texts, rows, gone = _without_copies(frame, said)
        sizes = [len(t) for t in frame.sort_values(["id", "tid"], na_position="last")["text"]] if gone else []
        marks = [(rows[k], 0, sizes[k]) for k in gone if sizes[k] >= length]
        said = said[said["bucket"] >= 0]
        sent: dict[int, list] = {}
        if len(said):
            wanted = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
            for k in (0, 1):
                of = said[(said["n"] < 0) == bool(k)]
                if len(of):
                    wanted[k] = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(of["bucket"], of["payload"], strict=True)])
            h, which, at, size = fragments(texts, length)
            known = _key(h, blocks)
            by_window = np.isin(known, wanted[1])
            keep = np.isin(known, wanted[0]) | by_window
            seen: dict[bytes, int] = {}
            for k, w, a, n, wide in zip(known[keep].tolist(), which[keep].tolist(), at[keep].tolist(), size[keep].tolist(), by_window[keep].tolist(), strict=True):
                part = texts[w][a : a + n]
                if seen.setdefault(part, ids[w]) < ids[w]:
                    marks.append((rows[w], a, a + n))
                elif not wide:
                    sent.setdefault(k >> 32, []).append((k, ids[w], rows[w], a, n, part))
                else:
                    for off in range(n - length + 1):
                        window = part[off : off + length]
                        if n > length and seen.setdefault(window, ids[w]) < ids[w]:
                            marks.append((rows[w], a + off, a + off + length))
                            continue
                        hashed = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big")
                        own = ((hashed >> 32) % blocks) << 32 | hashed & 0xFFFFFFFF
                        sent.setdefault(own >> 32, []).append((own, ids[w], rows[w], a + off, length, window))
        out = []
        for b, xs in sent.items():
            *columns, parts = zip(*xs, strict=True)
            out.append((b, key[0], len(xs), b"".join(np.array(c, t).tobytes() for c, t in zip(columns, _COLUMNS, strict=True)) + b"".join(parts)))
        if marks:
            out.append((key[0], key[0], 0, np.array(marks, _MARK).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "n", "payload"])

    def resolved(key, frame):
        """Marks of the windows that a smaller id has; marks that came (n = 0) pass through."""
        out: dict[int, list] = {}
        passed = []
        groups: dict[int, dict[bytes, list]] = {}
        for blk, n, data in zip(frame["block"].tolist(), frame["n"].tolist(), frame["payload"], strict=True):
            if not n:
                passed.append((key[0], blk, 0, data))
                continue
            columns, at = [], 0
            for t in _COLUMNS:
                columns.append(np.frombuffer(data, t, n, at).tolist())
                at += n * np.dtype(t).itemsize
            for k, i, row, a, size in zip(*columns, strict=True):
                groups.setdefault(k, {}).setdefault(data[at : at + size], []).append((i, row, a, blk))
                at += size
        pool: list[tuple[bytes, list]] = []

        def mark(occurrences, least):
            """``least``: the smallest id of each window."""
            for i, row, a, blk in occurrences:
                for s, e in _runs(least < i, length):
                    out.setdefault(blk, []).append((row, a + s, a + e))

        def settle():
            if pool:
                owners = np.array([min(o)[0] for _, o in pool], np.int64)
                for (_, occurrences), least in zip(pool, first_owners([t for t, _ in pool], owners, length), strict=True):
                    mark(occurrences, least)
                pool.clear()

        for of_anchor in groups.values():
            if len(of_anchor) > 1:
                pool.extend(of_anchor.items())
                if len(pool) >= COLLECTION:
                    settle()
                continue
            ((text, occurrences),) = of_anchor.items()
            lowest = min(occurrences)[0]
            for i, row, a, blk in occurrences:
                if i > lowest:
                    out.setdefault(blk, []).append((row, a, a + len(text)))
        settle()
        return pd.DataFrame(passed + [(key[0], b, 0, np.array(x, _MARK).tobytes()) for b, x in out.items()], columns=["bucket", "block", "n", "payload"])

    by_block = placed.groupBy("block")
    found = by_block.cogroup(copies.groupBy("block")).applyInPandas(anchors, FOUND).groupBy("bucket").applyInPandas(shared, FOUND)
    asked = found.unionByName(copies)
    marks = by_block.cogroup(asked.groupBy("block")).applyInPandas(candidates, FOUND).groupBy("bucket").applyInPandas(resolved, FOUND)

    def cut(key, frame, said):
        """What is left of each document."""
        spans: dict[int, list] = {}
        for data in said["payload"]:
            for row, a, b in np.frombuffer(data, _MARK).tolist():
                spans.setdefault(row, []).append((a, b))
        ids, texts, numbers = _rows(frame)
        rows = []
        for i, text, number, said_as in zip(ids, texts, numbers, frame["said"].tolist(), strict=True):
            kept, at, gone, runs, end = [], 0, 0, 0, -1
            for a, b in sorted(spans.get(number, ())):
                if a > end:  # touching runs are one
                    runs += 1
                if b > at:
                    kept.append(text[at : max(a, at)])
                    gone += b - max(a, at)
                    at = b
                end = max(end, b)
            kept.append(text[at:])
            rows.append((None if i == NO_ID else i, len(text), gone, runs, hashlib.sha256(b"".join(kept)).hexdigest(), said_as))
        result = pd.DataFrame(rows, columns=[*RESULT, "said"])
        return result.astype({"doc_id": "Int64"}) if len(result) else result

    return by_block.cogroup(marks.groupBy("block")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, said string")
