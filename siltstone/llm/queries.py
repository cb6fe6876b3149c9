"""The registered queries of the corpus operators, and SQL for those that
SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, mixing, ranked, secrets, warc
from .base import table


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    base, more = F.col("phrases.label"), F.col("notices.label")
    best = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("notices.containment"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.at").alias("first_word"), F.array_max("phrases.at").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), best.alias("score"),
    )


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removed

    return removed(table(spark, sf_dir, "documents"), length=50)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, seed=42, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctph import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan, written

    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import stored
    from .warc import read_archives, write_archives

    archives = stored(write_archives(table(spark, sf_dir, "pages"), least=0), "warc")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import TOXIC, held_out, score, trained

    docs = table(spark, sf_dir, "documents")
    found = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    said = F.concat_ws(",", F.transform("tox_spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= TOXIC).cast("int").alias("predicted"), said.alias("spans"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import duplicates

    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ctph": op1_ctph,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_pieces": op4_pieces,
    "op5_mixing": op5_mixing,
    "op6_embeddings": op6_embeddings,
    "op7_licenses": op7_licenses,
    "op8_suffixes": op8_suffixes,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_exact": op11_exact,
    "op12_ranked": op12_ranked,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op2_secrets": secrets.oracle(), "op3_warc": warc.ORACLE, "op5_mixing": mixing.ORACLE, "op11_exact": exact.ORACLE, "op12_ranked": ranked.ORACLE}
