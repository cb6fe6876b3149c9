"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next stage's documents.  Every stage works on all that
its predecessor kept.

In every stage, ids may be null or repeat, texts may be null, empty or of any
length, columns beside those of ``documents`` are dropped whatever they are
called, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, pieces, secrets, simhash, toxicity
from siltstone.llm.base import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to those of them that are labelled, rejects go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, carry=COLUMNS)
    return found.where(F.col("tox_score") < toxicity.TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the smallest id.  Rows are told apart by their
    texts, not by their ids.  Shingles of five words, a similarity of 0.8 or more."""
    return simhash.first_copies(docs.select(*COLUMNS), words=5, similarity=0.8, carry=COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in them is masked, private keys to their end."""
    found = secrets.scan(docs, secrets.WHOLE, carry=COLUMNS[2:4])
    masked = found.withColumn("text", F.when(F.size("spans") > 0, secrets.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return masked.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0 to 2); rows that repeat an id and a text alike."""
    return mixing.mixed(docs, carry=COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece numbers of the text."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The field of toxicity and the pieces are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
