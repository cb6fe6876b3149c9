"""What depends on a changed concept: a bounded walk against requirement edges, with witnesses.

Facts say that one concept requires another, or (negative) no longer does.  From
the changed concept a walk goes breadth first to what requires it.  The facts
are written once and stay in Spark: a level joins them with its own few nodes, and of what it finds
only as many rows come to the driver as the bound can use.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.shared import written

#: Bounds of a walk; events that witness one fact, at most (fixed values).
MOST_NODES, MOST_DEPTH, MOST_WITNESSES = 32, 8, 64


class Refused(ValueError):
    """``code``: unsupported or ambiguous."""

    def __init__(self, code: str, why: str):
        super().__init__(why)
        self.code = code


class Impact(NamedTuple):
    current: list[tuple]  # (id, depth, via): via are the claims that carry the path, from the changed concept on
    withdrawn: list[tuple]
    truncated: bool
    cycle: list[str] | None


def checked(facts: DataFrame) -> DataFrame:
    """``facts`` (claim_id, dependent, required, polarity, events), if they are fit to be walked."""
    bad = facts.agg(
        F.count(F.when(F.col("dependent").isNull() | F.col("required").isNull() | F.col("claim_id").isNull(), 1)).alias("blank"),
        F.count(F.when(~F.coalesce(F.col("polarity").isin("positive", "negative"), F.lit(False)), 1)).alias("polarity"),
        F.count(F.when(~F.coalesce(F.size("events").between(1, MOST_WITNESSES), F.lit(False)), 1)).alias("witnesses"),
    ).first()
    if any(bad):
        raise Refused("unsupported", f"facts without an identity: {bad[0]}, with another polarity: {bad[1]}, without a bounded list of witnesses: {bad[2]}")
    if not facts.groupBy("claim_id").count().where("count > 1").isEmpty():
        raise Refused("ambiguous", "a claim is repeated")
    if not facts.groupBy("dependent", "required").agg(F.min("polarity").alias("least"), F.max("polarity").alias("most")).where("least <> most").isEmpty():
        raise Refused("ambiguous", "a requirement has both polarities")
    return facts


def _walk(facts: DataFrame, root: str, nodes: int, depth: int) -> tuple[list[tuple], bool, list[str] | None]:
    spark = facts.sparkSession
    level = [(root, [], [root])]  # id, claims on the way, path
    found, seen, truncated, cycle = [], {root}, False, None
    for hop in range(depth + 1):
        if not level:
            break
        here = spark.createDataFrame([(n, i) for n, (i, *_) in enumerate(level)], "place int, required string")
        hit = facts.join(F.broadcast(here), "required")  # only the level's own facts are grouped
        if hop == depth:
            truncated = truncated or not hit.isEmpty()
            break
        met = hit.groupBy("place", "dependent").agg(F.sort_array(F.collect_list("claim_id")).alias("claims"))
        old = met.where(F.col("dependent").isin(sorted(seen)))  # at most the bound squared: for cycles
        new = met.where(~F.col("dependent").isin(sorted(seen))).orderBy("place", "dependent").limit((nodes - len(found) + 1) * len(level))
        rows = sorted(old.select("place", "dependent", F.lit(None).alias("claims")).collect() + new.select("place", "dependent", "claims").collect(), key=lambda r: (r[0], r[1]))
        following = []
        for place, child, claims in rows:
            _, via, path = level[place]
            if child in path:
                cycle = cycle or [*path, child]
            elif child not in seen:
                if len(found) == nodes:
                    return found, True, cycle
                seen.add(child)
                found.append((child, hop + 1, [*via, *claims]))
                following.append((child, [*via, *claims], [*path, child]))
        level = following
    return found, truncated, cycle


def impact(facts: DataFrame, changed: str, nodes: int = MOST_NODES, depth: int = MOST_DEPTH) -> Impact:
    """What requires ``changed`` now, and what no longer does, near first, in order of names.  Refused where the bound,
    a fact or the answer is not clear."""
    if not (1 <= nodes <= MOST_NODES and 1 <= depth <= MOST_DEPTH):
        raise Refused("unsupported", f"bounds beyond 1 to {MOST_NODES} nodes and 1 to {MOST_DEPTH} levels")
    facts = checked(written(facts.select("claim_id", "dependent", "required", "polarity", "events"), "facts"))  # made once, read by each level
    now, cut, loop = _walk(facts.where("polarity = 'positive'"), changed, nodes, depth)
    gone, also_cut, also_loop = _walk(facts.where("polarity = 'negative'"), changed, nodes, depth)
    if {i for i, *_ in now} & {i for i, *_ in gone}:
        raise Refused("ambiguous", "a concept both depends and no longer does")
    return Impact(now, gone, cut or also_cut, loop or also_loop)
