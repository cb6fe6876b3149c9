"""Lexical rank by cover density, with a title's likeness beside it.

A cover is a shortest stretch of a document that holds all words asked for.  It
counts the more the heavier its words and the fewer others stand between them.
Hits come from the index, so what is ranked are a question's own positions, a
few rows a document; the title's likeness is that of trigrams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.scalar import jaccard
from siltstone.operators import inverted as V

#: What a word in the title and one in the body weigh; the share of the title's likeness; likeness that makes a candidate.
TITLE, BODY, LIKENESS, CLOSE = 1.0, 0.1, 0.1, 0.2


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, two blanks before it and one behind."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(found, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def cover_density(hits: DataFrame, n_terms: int) -> DataFrame:
    """doc, density from hits: doc, term (0 to n_terms - 1), at (place), weight; documents without all terms are left out.

    At each hit the last hits of all terms are known; the earliest of them begins a stretch that ends here and holds
    all.  Of stretches with one beginning the first to end is a cover."""
    order = Window.partitionBy("doc").orderBy("at", "term")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("i", F.row_number().over(order)).withColumn("heft", F.sum(1.0 / F.col("weight")).over(so_far))
    last = [F.max(F.when(F.col("term") == k, F.struct("i", "at", (F.col("heft") - 1.0 / F.col("weight")).alias("before")))).over(so_far) for k in range(n_terms)]
    rows = rows.withColumn("begin", F.array_min(F.array(*last)) if n_terms > 1 else last[0])
    held = reduce(lambda x, y: x & y, (c.isNotNull() for c in last))
    covers = rows.withColumn("all", held).where("all").groupBy("doc", F.col("begin.i").alias("b")).agg(F.min(F.struct("i", "at", "heft")).alias("end"), F.first("begin").alias("begin"))
    inside = F.col("end.i") - F.col("begin.i")
    strangers = F.greatest(F.col("end.at") - F.col("begin.at") - inside, F.lit(0))
    worth = (inside + 1) / (F.col("end.heft") - F.col("begin.before")) / (1 + strangers)
    return covers.groupBy("doc").agg(F.sum(worth).alias("density"))


def hits(spark: SparkSession, index: V.Index, terms: list[str]) -> DataFrame:
    """doc, term, at, weight; the body's places follow the title's."""
    found = V.postings(spark, index, [(t, False) for t in terms], ("heads",))
    number = reduce(lambda e, kv: e.when(F.col("term") == kv[1], kv[0]), enumerate(terms), F.when(F.lit(False), 0))
    title = found.select("doc", number.alias("term"), F.explode("title").alias("at"), F.lit(TITLE).alias("weight"))
    body = found.select("doc", number.alias("term"), F.explode(F.transform("body", lambda p: p + F.col("heads"))).alias("at"), F.lit(BODY).alias("weight"))
    return title.unionByName(body)


def search(spark: SparkSession, index: V.Index, titles: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """doc, score: documents that hold all words of the query, or whose title (``titles``: doc, title) is like it, best
    first; the number of candidates follows the limit within bounds.  An empty query takes all, unranked."""
    terms = list(dict.fromkeys(V.words(query)))
    like = jaccard(word_trigrams(F.coalesce("title", F.lit(""))), word_trigrams(F.lit(query)))
    named = titles.select("doc", like.alias("like"))
    most = min(1000, max(200, 20 * limit))
    if not terms:
        return named.select("doc", F.lit(0.0).alias("score")).orderBy("doc").limit(most)
    found = named.join(cover_density(hits(spark, index, terms), len(terms)), "doc", "left").where(F.col("density").isNotNull() | (F.col("like") > CLOSE))
    return found.select("doc", (F.coalesce("density", F.lit(0.0)) + LIKENESS * F.col("like")).alias("score")).orderBy(F.desc("score"), "doc").limit(most)


