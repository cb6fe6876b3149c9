"""Mixing sources to target weights with hash thresholds, with DataFrame
functions only.

A document's place in its source's order is a hash of its id and text.  Sizes
are summed by source and hash bucket; running sums over the buckets show which
bucket a source's budget ends in, and only that bucket is split further, until
it holds one document or the hash is used up.  What results is one threshold a
source, and a filter applies it: nothing is sorted and reruns agree.  Where the
hash is used up, rows are alike, and as many of them are taken as fit: they are
numbered, by the parts of a written table, so no task holds them all.

Null and blank texts have size 0.  A null source is a source of its own, last
in order.  Rows that repeat an id and a text share a hash; so do rows without an
id that have one text.  Texts of any length are
hashed and counted whole.  Other columns are carried only where named, whatever
they are called, and an empty table gives an empty result.

The plan has one row for each source.  Rows meet it by ``hot_join``: the plan of
a source that holds a thousandth of the rows or more is broadcast, so no hot
source is shuffled, and neither is any other while the plan is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import hot_join, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of the hash, and those by which a round splits a bucket.
DIGITS, STEP = 15, 3
#: The name by which rows and plan meet: a null source is none of the others.
SOURCE_KEY = "mix_source"


def place(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits that order a source's documents."""
    said = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))
    return F.substring(F.md5(said.cast("binary")), 1, DIGITS)


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources``: source, source_size, a row each.  Adds ``target``: the sources
    share ``share`` times all sizes by weight; what exceeds ``most`` times a
    source's size goes to the others.  The windows run over the list of sources,
    not over documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), number + 1)).withColumn("cap", most * F.col("source_size"))
    ratio = Window.orderBy("by", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    level = (
        weighed.withColumn("by", F.col("cap") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(all_rows))
        .withColumn("filled", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("by"), F.col("level"))).over(all_rows))
    )
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, total: int) -> DataFrame:
    """For each source the prefix at which its budget ends and what is there: SOURCE_KEY, cut, before (sizes in front
    of it), each (a document's size), docs, budget.

    ``sized``: SOURCE_KEY, size, place.  ``budgets``: SOURCE_KEY, budget, w (its
    rows, of ``total``).  A document is taken while what is before it and half of
    it stay within the budget."""
    state = stored(budgets.select(SOURCE_KEY, "budget", "w", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before")), "cuts")
    for n in range(STEP, DIGITS + 1, STEP):
        inside = hot_join(sized, state.withColumn("rows", F.col("w")), SOURCE_KEY, "rows", total).where(F.substring("place", 1, n - STEP) == F.col("cut"))
        sums = inside.groupBy(SOURCE_KEY, "budget", "w", "before", F.substring("place", 1, n).alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        run = F.col("before") + F.sum("n").over(Window.partitionBy(SOURCE_KEY).orderBy("bucket"))  # 4096 buckets at most
        # the first bucket that the budget does not wholly hold; the last one if there is none
        ranked = sums.withColumn("run", run).withColumn("ends", F.col("run") > F.col("budget"))
        first = ranked.groupBy(SOURCE_KEY, "budget", "w").agg(
            F.min(F.when(F.col("ends"), F.struct("bucket", (F.col("run") - F.col("n")).alias("before"), "n", "docs"))).alias("at"),
            F.max(F.struct("bucket", (F.col("run") - F.col("n")).alias("before"), "n", "docs")).alias("end"),
        )
        cut = F.coalesce("at", "end")
        state = stored(first.select(SOURCE_KEY, "budget", "w", cut["bucket"].alias("cut"), cut["before"].alias("before"), cut["n"].alias("n"), cut["docs"].alias("docs")), "cuts")
        if n < DIGITS and not state.where("docs > 1").limit(1).count():
            break
    return state.select(SOURCE_KEY, "cut", "before", (F.col("n") / F.col("docs")).alias("each"), "docs", "budget")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, place and SOURCE_KEY of each row, without its text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"), place(id_col, text_col).alias("place"), source_key(F.col(source_col)).alias(SOURCE_KEY))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> tuple[DataFrame, int]:
    """A row for each source (SOURCE_KEY, w, source_size, target, times and those of ``thresholds``), and the number of rows."""
    sources = sized.groupBy("source", SOURCE_KEY).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("w"))
    sources = stored(sources, "sources")
    total = sources.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    goal = targets(sources, weights, share, float(most)).withColumn(SOURCE_KEY, source_key(F.col("source"))).drop("source").join(sources.select(SOURCE_KEY, "w"), SOURCE_KEY)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = stored(goal.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")), "targets")
    return stored(goal.drop("budget").join(thresholds(sized, goal, total), SOURCE_KEY), "plan"), total


def taken(rows: DataFrame, planned: DataFrame, total: int) -> DataFrame:
    """``rows`` (with SOURCE_KEY and place) and how often the mix takes each: ``copies``."""
    fits = lambda j: F.col("before") + (j - 0.5) * F.col("each") <= F.col("budget")
    parted = fits(F.lit(1)) & ~fits(F.col("docs"))
    goal = planned.withColumn("parted", parted).withColumn("whole", ~parted & fits(F.col("docs")))
    met = hot_join(rows, goal, SOURCE_KEY, "w", total)
    prefix = F.expr("substring(place, 1, length(cut))")
    at_cut = prefix == F.col("cut")
    more = (prefix < F.col("cut")) | (at_cut & F.col("whole"))
    gone = ("times", "cut", "before", "each", "docs", "budget", "parted", "whole", SOURCE_KEY)
    plain = met.where(~(at_cut & F.col("parted"))) if goal.where("parted").limit(1).count() else None
    if plain is None:
        return met.withColumn("copies", F.col("times") + F.when(more, 1).otherwise(0)).drop(*gone)
    # rows alike, of which a part is taken: numbered within the parts of what was written, behind those of the parts before
    alike = stored(met.where(at_cut & F.col("parted")).withColumn("mix_part", F.spark_partition_id()), "alike")
    sums = alike.groupBy(SOURCE_KEY, "mix_part").agg(F.count(F.lit(1)).alias("n"))
    behind = F.coalesce(F.sum("n").over(Window.partitionBy(SOURCE_KEY).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(SOURCE_KEY, "mix_part", behind.alias("mix_behind"))
    own = F.row_number().over(Window.partitionBy(SOURCE_KEY, "mix_part").orderBy("place"))
    numbered = alike.withColumn("mix_own", own).join(offsets, [SOURCE_KEY, "mix_part"])
    some = numbered.withColumn("copies", F.col("times") + F.when(fits(F.col("mix_behind") + F.col("mix_own")), 1).otherwise(0)).drop("mix_part", "mix_own", "mix_behind")
    return plain.withColumn("copies", F.col("times") + F.when(more, 1).otherwise(0)).drop(*gone).unionByName(some.drop(*gone))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, place, size, source_size, target and ``copies`` (0 to ``most``)
    for each row.  A target of k sizes and a part takes every document k times
    and those within the part's threshold once more."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    found = taken(sized, *plan(sized, weights, share, most))
    return found.select(id_col, "source", "place", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, carry: tuple[str, ...], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns in ``carry`` of each row, as many times as the mix takes it.  The rows meet the plan where they are:
    no text is shuffled while Spark can broadcast the plan."""
    planned = plan(stored(sizes(docs, id_col, text_col, source_col), "sizes"), weights, share, most)
    rows = docs.select(F.struct(*carry).alias("of"), place(id_col, text_col).alias("place"), source_key(F.col(source_col)).alias(SOURCE_KEY))
    return taken(rows, *planned).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("of.*")


ORACLE = r"""WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
 substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS place FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS i FROM docs GROUP BY source),
w AS (SELECT source, source_size, CASE i WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap,
 1.5::DOUBLE * (SELECT sum(source_size) FROM src) AS total FROM src),
o AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
 sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
lv AS (SELECT max((total - filled) / open) FILTER ((total - filled) / open <= ratio) AS level FROM o),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM lv) * weight, cap)) AS target FROM w),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM g),
ties AS (SELECT source, place, sum(size) AS n, count(*) AS docs FROM docs GROUP BY source, place),
run AS (SELECT source, place, n, docs, sum(n) OVER (PARTITION BY source ORDER BY place) - n AS before FROM ties)
SELECT d.doc_id, d.size, t.source_size, t.target,
 (d.size * (t.times + CASE WHEN r.before + (d.j - 0.5::DOUBLE) * (r.n / r.docs) <= t.target - t.times * t.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, place) AS j FROM docs) d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN run r ON d.source IS NOT DISTINCT FROM r.source AND d.place = r.place"""
