"""A persisted inverted index, kept by batches and read by the buckets of the terms asked for.

An index is a folder of segments and a manifest.  A segment has postings, one
for each word and document, in folders by bucket (a hash of the word's first
letters, so a prefix has one bucket too), and the documents it speaks of, a row
each with what ranking needs of it.  A row of postings holds those of a word in
neighbouring documents; a row for each, with its document's columns, would take
most of the building's time.  A search reads the buckets of its words, and the
documents' rows where it ranks by them.  A batch is a segment:
what it says of a document, or that it is gone, holds against all segments
before.  The manifest's last row is written when a segment is whole, so a reader
sees all of a batch or nothing, and a batch that runs again is known by its name
and adds nothing.  ``compacted`` writes one segment of what is live and moves
readers over by one row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.search import parse_query

#: Buckets of an index, and letters of a word that choose its bucket.
BUCKETS, LETTERS = 64, 2
MANIFEST = "sequence long, batch string, kind string, segment string, n_docs long, n_words double"
KNOWN = "length int, words double, heads int, machine boolean, title_hash long"
DOCS = f"doc long, deleted boolean, {KNOWN}"
POSTING = "bucket int, term string, doc long, title array<int>, body array<int>"
#: A row of a segment; ``doc`` is its smallest document.  The rows without a term tell the documents' columns.
PACKED = f"bucket int, term string, doc long, postings array<struct<doc long, title array<int>, body array<int>>>, documents array<struct<doc long, {KNOWN}>>"
_WORD, _ASCII = regex.compile(r"[\p{L}\p{N}\p{M}]+"), re.compile("[A-Za-z0-9]+")
#: Words (or documents) whose postings are sorted at once; documents that are broadcast when an index is compacted, at most;
#: bytes of postings that are packed at once when it is.
CHUNK, FEW, HELD = 1 << 20, 2_000_000, 64 << 20
_names = lambda columns: [c.split()[0] for c in columns.split(", ")]
_FIELDS, _KNOWN, _COLUMNS = _names(POSTING)[2:], _names(KNOWN), ["term", "doc", "postings", "documents"]
#: The folder of the documents' columns, and how many files a task may hold open.
DOCUMENTS, OPEN = -1, "spark.sql.maxConcurrentOutputFileWriters"


def fold(word: str) -> str:
    """Lower case without marks: café, CAFÉ and cafe are one word."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return [w for w in map(fold, _WORD.findall(text)) if w]


@cache
def _wide() -> tuple[re.Pattern, re.Pattern]:
    """What ``_WORD`` matches of the first 65 536 code points, as the faster module looks for it, and code points beyond."""
    runs = _WORD.findall("".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000))
    return re.compile(f"[{''.join(f'{r[0]}-{r[-1]}' for r in runs)}]+"), re.compile("[\U00010000-\U0010ffff]")


def _found(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text)
    near, beyond = _wide()
    return (_WORD if beyond.search(text) else near).findall(text)


class Index(NamedTuple):
    """Where an index lies, and how a batch's columns are called."""

    path: str
    buckets: int = BUCKETS
    title_weight: float = 4.0


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LETTERS)), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, index: Index) -> list:
    """Rows from the last whole index on; none where there is no index yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{index.path}/manifest").orderBy("sequence").collect()  # a row a batch since compaction, about
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    start = max((i for i, r in enumerate(rows) if r["kind"] == "base"), default=0)
    return rows[start:]


class _Terms(dict):
    """Number of each word's folded form in ``terms``, -1 where nothing is left of it."""

    def __init__(self):
        super().__init__()
        self.terms, self.numbers = [], {}

    def __missing__(self, word: str) -> int:
        term = fold(word)
        n = self.numbers.setdefault(term, len(self.terms)) if term else -1
        if n == len(self.terms):
            self.terms.append(term)
        self[word] = n
        return n


def _numbers(text: str, terms: _Terms) -> np.ndarray:
    found = _found(text)
    out = np.fromiter(map(terms.__getitem__, found), np.int32, len(found))
    return out[out >= 0]


def _sorted(docs: list[tuple], fields: list[np.ndarray], terms: list[str], weight: float) -> pa.RecordBatch:
    """PACKED but for the bucket: postings of some documents (doc, length, machine, title hash) by term, and behind them the
    row without a term.  ``fields``: numbers of the words of each one's title and body."""
    sizes = np.array([len(f) for f in fields])
    starts = np.cumsum(sizes) - sizes
    field = np.repeat(np.arange(len(fields), dtype=np.int32), sizes)
    at = (np.arange(len(field)) - np.repeat(starts, sizes)).astype(np.int32)
    alphabet = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int64)
    rank[alphabet] = np.arange(len(terms))
    keys = np.sort(rank[np.concatenate(fields)] << 32 | np.arange(len(field)))  # words come by document, field and place
    order, term = keys & 0xFFFFFFFF, keys >> 32
    field, at = field[order], at[order]
    doc, heading = field >> 1, (field & 1) == 0
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.empty(0, np.int64)

    def places(keep: np.ndarray) -> pa.Array:
        ends = np.r_[0, np.cumsum(keep)]
        return pa.ListArray.from_arrays(pa.array(np.r_[ends[new], ends[-1]], pa.int32()), pa.array(at[keep], pa.int32()))

    ids, lengths, machines, hashes = (pa.array(c, t) for c, t in zip(zip(*docs, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64()), strict=True))
    heads = sizes[::2]
    known = [ids, lengths, pa.array(sizes[1::2] + weight * heads, pa.float64()), pa.array(heads, pa.int32()), machines, hashes]
    return _rows(pa.array([terms[i] for i in alphabet], pa.string()), term[new], [ids.take(pa.array(doc[new])), places(heading), places(~heading)], known)


def _rows(names: pa.Array, of_term: np.ndarray, columns: list[pa.Array], known: list[pa.Array] | None = None) -> pa.RecordBatch:
    """A row for each run of postings (``columns``) with one term (places in ``names``); a row without a term for ``known``."""
    first = np.flatnonzero(np.r_[True, of_term[1:] != of_term[:-1]]) if len(of_term) else np.empty(0, np.int64)
    ids = columns[0].fill_null(np.iinfo(np.int64).max).to_numpy()
    least = np.minimum.reduceat(ids, first) if len(first) else first
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(of_term)], pa.int32()), pa.StructArray.from_arrays(columns, names=_FIELDS))
    parts = [names.take(pa.array(of_term[first])), pa.array(least, pa.int64()), lists]
    said = pa.StructArray.from_arrays(known or [pa.nulls(0, t) for t in (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.int64())], names=["doc", *_KNOWN])
    rows = pa.RecordBatch.from_arrays([*parts, pa.ListArray.from_arrays(pa.array(np.zeros(len(first) + 1), pa.int32()), said[:0])], names=_COLUMNS)
    if not known:
        return rows
    last = pa.RecordBatch.from_arrays([pa.array([""]), pa.nulls(1, pa.int64()), lists[:0].take(pa.nulls(1, pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(said)], pa.int32()), said)], names=_COLUMNS)
    return pa.Table.from_batches([rows, last]).combine_chunks().to_batches()[0]


def _packed(postings: DataFrame) -> DataFrame:
    """PACKED, from POSTING: a task packs some postings at a time, as they lie."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        terms = rows["term"].combine_chunks().dictionary_encode()
        of_term = terms.indices.to_numpy()
        order = np.argsort(of_term, kind="stable")
        return _rows(terms.dictionary, of_term[order], [rows[c].combine_chunks().take(pa.array(order)) for c in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return postings.select("term", *_FIELDS).mapInArrow(run, PACKED.removeprefix("bucket int, "))


def _postings(docs: DataFrame, index: Index) -> DataFrame:
    """PACKED but for the bucket, from key, title, body, machine.  Each text is cut into words where it lies; the postings
    of CHUNK words at a time are sorted in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fields, terms, n = [], [], _Terms(), 0
        for batch in batches:
            for doc, title, body, machine, hashed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((doc, len(body), machine, hashed))
                fields += [_numbers(title, terms), _numbers(body, terms)]
                n += len(fields[-2]) + len(fields[-1])
                if n >= CHUNK or len(held) >= CHUNK:
                    yield _sorted(held, fields, terms.terms, index.title_weight)
                    held, fields, terms, n = [], [], _Terms(), 0
        if held:
            yield _sorted(held, fields, terms.terms, index.title_weight)

    title = F.coalesce("title", F.lit(""))
    rows = docs.select(F.col("doc"), title.alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("machine", F.lit(False)).alias("machine"), title_hash(title).alias("hash"))
    return rows.mapInArrow(run, PACKED.removeprefix("bucket int, "))


def title_hash(title: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(title)))


def _write(packed: DataFrame, index: Index, path: str) -> None:
    """Packed postings in folders by bucket.  A task holds a file open for each bucket, so they are neither shuffled nor sorted."""
    placed = packed.withColumn("bucket", F.when(F.col("term") == "", DOCUMENTS).otherwise(bucket_of(F.col("term"), index.buckets)))
    conf = packed.sparkSession.conf
    before = conf.get(OPEN)
    conf.set(OPEN, str(index.buckets + 2))
    try:
        placed.write.partitionBy("bucket").parquet(path)
    finally:
        conf.set(OPEN, before)


def _segment(spark: SparkSession, index: Index, segment: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(f"{index.path}/{segment}/postings")


def _add(spark: SparkSession, index: Index, batch: str, kind: str, segment: str, n_docs: int, n_words: float, sequence: int) -> None:
    row = spark.createDataFrame([(sequence, batch, kind, segment, n_docs, n_words)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{index.path}/manifest")


def _documents(spark: SparkSession, index: Index, rows: list) -> DataFrame:
    """DOCS and seq: what the segments say of documents."""
    read = [spark.read.schema(DOCS).parquet(f"{index.path}/{r['segment']}/docs").withColumn("seq", F.lit(r["sequence"]).cast("long")) for r in rows]
    return reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], DOCS + ", seq long")


def _latest(batch: DataFrame) -> DataFrame:
    """The last in ``version`` of a document's rows.  Only documents that come more than once are grouped with their texts."""
    several = batch.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    if several.isEmpty():
        return batch
    last = batch.join(several, "doc", "left_semi").groupBy("doc").agg(F.max_by(F.struct(*batch.columns), "version").alias("r")).select("r.*")
    return batch.join(several, "doc", "left_anti").select(*batch.columns).unionByName(last)


def apply(index: Index, batch: DataFrame, name: str) -> bool:
    """Take a batch in: doc, title, body, machine, deleted; of a document's several rows the last in ``version``.  False
    if a batch of this name is in."""
    spark = batch.sparkSession
    rows = manifest(spark, index)
    if any(r["batch"] == name for r in rows):
        return False
    segment = f"segment-{uuid.uuid4().hex}"
    once = _latest(batch)
    _write(_postings(once.where("NOT deleted"), index), index, f"{index.path}/{segment}/postings")
    known = _segment(spark, index, segment).where(F.col("bucket") == DOCUMENTS).select(F.inline("documents")).withColumn("deleted", F.lit(False))
    said = known.unionByName(once.where("deleted").select("doc", "deleted", F.lit(0.0).alias("words")), allowMissingColumns=True)
    said.write.parquet(f"{index.path}/{segment}/docs")
    said = spark.read.schema(DOCS).parquet(f"{index.path}/{segment}/docs")
    mine = said.where("NOT deleted").agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0.0))).first()
    before = _documents(spark, index, rows).join(said.select("doc"), "doc", "left_semi")
    before = before.groupBy("doc").agg(F.max_by(F.struct("deleted", "words"), "seq").alias("r")).where("NOT r.deleted")
    old = before.agg(F.count(F.lit(1)), F.coalesce(F.sum("r.words"), F.lit(0.0))).first()
    _add(spark, index, name, "delta" if rows else "base", segment, mine[0] - old[0], mine[1] - old[1], rows[-1]["sequence"] + 1 if rows else 0)
    return True


def _live(said: DataFrame, *columns: str) -> DataFrame:
    """The last that is said of each document that is not gone."""
    return said.groupBy("doc").agg(F.max_by(F.struct("seq", "deleted", *columns), "seq").alias("r")).select("doc", "r.*").where("NOT deleted").drop("deleted")


def postings(spark: SparkSession, index: Index, forms: list[tuple[str, bool]] | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """Live postings of the words asked for (word, whether it is a prefix); of all words without ``forms``.  Only the
    words' buckets are read.  What later segments say of a document outdates its postings.  ``known``: columns of the
    documents (KNOWN) that are joined to them."""
    rows = manifest(spark, index)
    if not rows:
        return spark.createDataFrame([], ", ".join([POSTING, *(c for c in KNOWN.split(", ") if c.split()[0] in known)]))
    read = []
    for r in rows:
        of = _segment(spark, index, r["segment"])
        if forms is not None:
            keep = reduce(lambda x, y: x | y, (F.startswith("term", F.lit(w)) if prefix else F.col("term") == w for w, prefix in forms), F.lit(False))
            if all(len(w) >= LETTERS or not prefix for w, prefix in forms):
                heads = sorted({w[:LETTERS] for w, _ in forms})
                ids = spark.range(1).select(F.array(*(bucket_of(F.lit(h), index.buckets) for h in heads)).alias("b")).first()[0] if heads else []
                of = of.where(F.col("bucket").isin(*ids))
            of = of.where(keep)
        else:
            of = of.where(F.col("bucket") != DOCUMENTS)
        read.append(of.select("bucket", "term", F.inline("postings")).withColumn("seq", F.lit(r["sequence"]).cast("long")))
    found = reduce(DataFrame.unionByName, read)
    if known:
        said = _documents(spark, index, rows)
        live = (_live(said, *known) if len(rows) > 1 else said.select("doc", "seq", *known)).withColumnsRenamed({"doc": "of", "seq": "last"})
        found = found.join(live, F.col("doc").eqNullSafe(F.col("of")) & (F.col("seq") == F.col("last"))).drop("of", "last")
    elif len(rows) > 1:
        later = _documents(spark, index, rows[1:]).groupBy("doc").agg(F.max("seq").alias("last"))
        later = F.broadcast(later) if forms is None and later.count() <= FEW else later
        found = found.join(later, "doc", "left").where("last IS NULL OR seq = last").drop("last")
    return found.drop("seq")


def compacted(spark: SparkSession, index: Index) -> str:
    """One segment of what is live, in place of all; returns its name.  Nothing of an erased document is in it."""
    rows = manifest(spark, index)
    segment = f"segment-{uuid.uuid4().hex}"
    _write(_packed(postings(spark, index)), index, f"{index.path}/{segment}/postings")
    _live(_documents(spark, index, rows), *_KNOWN).drop("seq").withColumn("deleted", F.lit(False)).write.parquet(f"{index.path}/{segment}/docs")
    n, total = spark.read.schema(DOCS).parquet(f"{index.path}/{segment}/docs").agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0.0))).first()
    _add(spark, index, rows[-1]["batch"] if rows else "", "base", segment, n, total, rows[-1]["sequence"] + 1 if rows else 0)
    return segment


def maintain(stream: DataFrame, index: Index, checkpoint: str, every: int = 8) -> StreamingQuery:
    """Keep an index by the batches of a stream (doc, version, title, body, machine, deleted); every so many it is compacted."""

    def batch(rows: DataFrame, number: int) -> None:
        apply(index, rows, f"{checkpoint}#{number}")
        if len(manifest(rows.sparkSession, index)) > every:
            compacted(rows.sparkSession, index)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _starts(fields: list[Column]) -> Column:
    """Places where a phrase's words follow each other, counted from the left without overlap."""
    first, *rest = fields
    if not rest:
        return F.size(first)
    starts = F.array_sort(F.filter(first, lambda p: reduce(lambda x, y: x & y, (F.array_contains(r, (p + k + 1).cast("int")) for k, r in enumerate(rest)))))
    none = F.struct(F.lit(-1).alias("free"), F.lit(0).alias("n"))
    step = lambda acc, p: F.when(p >= acc["free"], F.struct((p + len(fields)).alias("free"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return F.aggregate(starts, none, step, lambda acc: acc["n"])


def literal(spark: SparkSession, index: Index, query: str, limit: int) -> DataFrame:
    """doc, exact, score: as ``search.literal``, from the index.  Words are folded."""
    parts = [(words(p), q) for p, q in parse_query(query)]
    parts = [(w, q) for w, q in parts if w]
    if not parts:
        return spark.createDataFrame([], "doc long, exact boolean, score double")
    asked = [(i, j, w, prefix and j == len(ws) - 1) for i, (ws, prefix) in enumerate(parts) for j, w in enumerate(ws)]
    found = postings(spark, index, [(w, p) for *_, w, p in asked], ("length", "machine", "title_hash"))
    fits = lambda w, p: F.startswith("term", F.lit(w)) if p else F.col("term") == w
    lists = [F.flatten(F.collect_list(F.when(fits(w, p), F.col(field)))).alias(f"{field}_{i}_{j}") for i, j, w, p in asked for field in ("title", "body")]
    docs = found.groupBy("doc").agg(F.first("length").alias("length"), F.first("machine").alias("machine"), F.first("title_hash").alias("hash"), *lists)
    of = lambda field, i: _starts([F.col(f"{field}_{i}_{j}") for j in range(len(parts[i][0]))])
    docs = docs.select("doc", "length", "machine", "hash", *(of(field, i).alias(f"{field}{i}") for field in ("title", "body") for i in range(len(parts))))
    held = reduce(lambda x, y: x & y, (F.col(f"title{i}") + F.col(f"body{i}") > 0 for i in range(len(parts))))
    total = lambda field: sum((F.col(f"{field}{i}") for i in range(len(parts))), F.lit(0))
    f = lambda x: x / (1 + x)
    score = (4 * f(total("title")) + f(total("body"))) / (1000 + F.least("length", F.lit(1000))) * F.when(F.col("machine"), 0.5).otherwise(1.0)
    exact = F.col("hash") == title_hash(F.lit(query))
    return docs.where(held).select("doc", exact.alias("exact"), score.alias("score")).orderBy(F.desc("exact"), F.desc("score"), "doc").limit(limit)


def relaxed(spark: SparkSession, index: Index, terms: list[tuple[str, ...]], need: int) -> DataFrame:
    """doc, covered, coverage: as ``search.relaxed``, from the index."""
    if not terms:
        return spark.createDataFrame([], "doc long, covered int, coverage double")
    forms = [(fold(x.rstrip("*")), x.endswith("*")) for t in terms for x in t]
    one = lambda x: F.startswith("term", F.lit(fold(x.rstrip("*")))) if x.endswith("*") else F.col("term") == fold(x)
    held = [F.max(reduce(lambda a, b: a | b, map(one, t)).cast("int")).alias(f"t{k}") for k, t in enumerate(terms)]
    docs = postings(spark, index, forms).where(F.size("body") > 0).groupBy("doc").agg(*held)
    covered = sum((F.col(f"t{k}") for k in range(len(terms))), F.lit(0))
    return docs.select("doc", covered.alias("covered")).where(F.col("covered") >= need).withColumn("coverage", F.col("covered") / len(terms))


def bm25(spark: SparkSession, index: Index, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc, score: as ``search.bm25``, from the index; the corpus's size and mean length stand in the manifest."""
    rows = manifest(spark, index)
    n = sum(r["n_docs"] for r in rows)
    mean = sum(r["n_words"] for r in rows) / n if n else 1.0
    terms = list(dict.fromkeys(map(fold, terms)))
    found = postings(spark, index, [(t, False) for t in terms], ("words",))
    df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a term asked for
    tf = F.size("body") + index.title_weight * F.size("title")
    idf = F.coalesce(*(F.when(F.col("term") == t, F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))) for t, d in df.items()), F.lit(0.0))
    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("words") / F.lit(mean)))
    return found.groupBy("doc").agg(F.sum(score).alias("score"))
