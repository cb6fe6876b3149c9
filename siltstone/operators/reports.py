"""Reports over the ledger: coverage, calibration, briefs, budgets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import scan


def coverage(ledger: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Rows, first and last time, rows without a value, and a state, of each source."""
    out = ledger.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.sum(F.col(value).isNull().cast("long")).alias("n_blind"))
    return out.withColumn("state", F.when(F.col("n_rows") < 20, "sparse").when(F.col("n_blind") > 0, "blind").otherwise("covered"))


def budget(rows: DataFrame, group: str, order: str, cost: str, cap: int, parts: int = 64, descending: bool = True) -> DataFrame:
    """Rows of each group in order while their running cost stays within the cap; adds ``running``.

    The values of ``order`` are cut into ``parts`` ranges.  Costs are summed by group and range first; a row's running
    cost is that of the ranges before it, which are a few rows a group, and of its own range, so a hot group is no hot
    task.  Ranges that start over the cap are left out before anything is sorted."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    at = F.least(F.lit(parts - 1), F.floor((F.col(order) - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1)))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("_r", (parts - 1 - at if descending else at).cast("int")).drop("lo", "hi")
    sums = placed.groupBy(group, "_r").agg(F.sum(cost).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sums.withColumn("_b", before).where(F.col("_b") <= cap).drop("_s")
    w = Window.partitionBy(group, "_r").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(open_, [group, "_r"]).withColumn("running", F.col("_b") + F.sum(cost).over(w)).where(F.col("running") <= cap).drop("_r", "_b")


def spent(calls: DataFrame, at: str, name: str, amount: str) -> DataFrame:
    """What each name used on each UTC day."""
    return calls.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), name).agg(F.sum(amount).alias("used"), F.count(F.lit(1)).alias("n"))


def calibration(runs: DataFrame, claims: DataFrame, newest: int = 10_000, least: int = 8, bands: tuple[float, float] = (0.2, 0.9)) -> DataFrame:
    """Rates of a producer's runs (extracted, written, merged) and the spread of the confidence of its newest claims
    (claim_id, asserted_at, confidence, capped); whether the write rate is out of its band, where the sample is not small."""
    rates = runs.agg(F.sum("extracted").alias("extracted"), F.sum("written").alias("written"), F.sum("merged").alias("merged"))
    recent = claims.orderBy(F.desc("asserted_at"), F.desc("claim_id")).limit(newest)
    spread = recent.where(~F.col("capped")).agg(F.count(F.lit(1)).alias("sample"), F.stddev_samp("confidence").alias("spread"))
    share = lambda c: F.col(c) / F.greatest(F.lit(1), F.col("extracted"))
    both = rates.crossJoin(spread).withColumns({"write_rate": share("written"), "dedup_rate": share("merged")})
    return both.select("write_rate", "dedup_rate", "sample", "spread", ((F.col("sample") >= least) & ~F.col("write_rate").between(*bands)).alias("out_of_band"))


def agent_metrics(answers: DataFrame, by: str) -> DataFrame:
    """Recall, stale rate, leaks, share with provenance, and mean tokens of served answers."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return answers.groupBy(by).agg(share("found").alias("recall"), share("stale").alias("stale_rate"), F.sum(F.col("leaked").cast("long")).alias("leaks"), share("sourced").alias("provenance_rate"), F.avg("tokens").alias("tokens"))


def sections(items: DataFrame, group: str, section: str, order: list, cost: str, cap: int, most: int = 5, share: float = 0.5) -> DataFrame:
    """At most ``most`` items of each section of a session, while the section stays within its share of the budget."""
    w = Window.partitionBy(group, section).orderBy(*order)
    rows = items.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return rows.withColumn("running", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= cap * share)


def read_groups(claims: DataFrame, key: str, size: str, order: str, most: int = 16, bytes_: int = 65_536) -> DataFrame:
    """Keys with two claims or more, within bounds of number and bytes, the one whose newest claim is newest first."""
    out = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(order).alias("newest"))
    return out.where(F.col("n").between(2, most) & (F.col("bytes") <= bytes_)).orderBy(F.desc("newest"), key)


def packed(rows: DataFrame, group: str, order: list[str], cost: str, cap: int, mandatory: str | None = None) -> DataFrame:
    """Greedy packing: in order, mandatory rows first, a row that does not fit is skipped and a later, smaller one may
    follow.  Rows of a group fold into one running state; groups are the few hundred candidates of one packet."""
    first = [(~F.col(mandatory)).cast("int").alias("_m")] if mandatory else []
    seq = F.array_sort(F.collect_list(F.struct(*first, *order, F.col(cost).cast("long").alias("cost"))))
    step = lambda acc, x: F.when(acc["used"] + x["cost"] <= cap, F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["kept"], x[order[-1]]).alias("kept"))).otherwise(acc)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    done = rows.groupBy(group).agg(F.aggregate(seq, start, step).alias("p"))
    return done.select(group, F.explode("p.kept").alias(order[-1]), F.col("p.used").alias("used"))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """group, share, value: the least value up to which lie that share of the group's rows.

    Rows fold to counts of values, and the counts are summed along ranges of (group, value), so neither a group nor its
    distinct values come together in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = scan.running(scan.ranged(counts, "_g", "_v"), ("_g",), ("_v",), ("_upto", "sum", F.col("_n")))
    totals = counts.groupBy("_g").agg(F.sum("_n").alias("_all"))
    asked = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    wanted = totals.select(F.col("_g").alias("_group"), "_all", asked.alias("share")).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("_all"))))
    reached = upto.join(wanted, F.col("_g").eqNullSafe(F.col("_group")) & (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    return reached.select(F.col("_g").alias(group), "share", F.col("_v").alias(value))
