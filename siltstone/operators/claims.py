"""Claims over time: conflicts, resolution, gaps, supersession, what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31 00:00:00"
MARGIN = 0.15


def _end(c) -> Column:
    return F.coalesce(c, F.to_timestamp_ntz(F.lit(FAR)))


def overlaps(a: str, b: str) -> Column:
    """Half-open intervals; a null end is open."""
    return (F.col(f"{a}.valid_from") < _end(F.col(f"{b}.valid_to"))) & (F.col(f"{b}.valid_from") < _end(F.col(f"{a}.valid_to")))


#: Predicates that hold one value at a time; all others hold several (fixed values).
SINGLE_VALUED = (
    "identity.display_name", "location.based_in", "employment.works_at", "employment.role", "project.status", "commitment.due", "relation.reports_to",
)


def disagrees() -> Column:
    """Opposite polarity, or another object where the predicate holds one value."""
    return (F.col("a.polarity") != F.col("b.polarity")) | (F.col("a.single") & (F.col("a.object") != F.col("b.object")))


#: Claims of a key that a task pairs with all of the key's, about.
SPLIT = 2000


def conflicts(claims: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs (a the older, b the newer) of one key whose intervals overlap and that disagree.  ``claims``: claim_id,
    claim_key, object, valid_from, valid_to, tier, confidence; polarity and single where there are such columns.

    The newer side is dealt out by a salt and the older repeated for each, so that the pairs of a hot key, which grow with
    its square, are spread: over ``parts`` tasks, or by the key's own count over one for SPLIT claims."""
    for name, value in (("polarity", F.lit("positive")), ("single", F.lit(True))):
        if name not in claims.columns:
            claims = claims.withColumn(name, value)
    if parts is None:
        big = claims.groupBy("claim_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("claim_key", F.ceil(F.col("n") / SPLIT).cast("int").alias("_parts"))
        salted = claims.join(big, "claim_key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    else:
        salted = claims.withColumn("_parts", F.lit(parts))
    a = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("a")
    b = salted.withColumn("salt", F.pmod(F.xxhash64("claim_id"), F.col("_parts")).cast("int")).alias("b")
    on = (F.col("a.claim_key") == F.col("b.claim_key")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.claim_id") < F.col("b.claim_id")) & disagrees() & overlaps("a", "b")
    return a.join(b, on)


def resolution(purged: Column | None = None) -> Column:
    """struct(rule, action, winner) for a conflict of aliases a (live) and b (incoming).

    A purged claim yields (R6).  A correction beats all but another one (R5), and nothing else beats it (R1); a model's
    inference never beats evidence (R2); a higher tier wins (R1).  Within a tier the later start wins, then the higher
    confidence, then the larger id (R3); unless, in the lower two tiers, the winner's confidence does not exceed the
    loser's by MARGIN: then both stand, contested (R4)."""
    live, incoming = F.col("a.tier"), F.col("b.tier")
    order = lambda s: F.struct(F.col(f"{s}.valid_from"), F.col(f"{s}.confidence"), F.col(f"{s}.claim_id"))
    newer = order("b") > order("a")
    margin = F.when(newer, F.col("b.confidence") - F.col("a.confidence")).otherwise(F.col("a.confidence") - F.col("b.confidence"))
    of = lambda rule, action, winner=None: F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.lit(winner).cast("string").alias("winner"))
    later = F.when(newer, of("R3", "supersede", "incoming")).otherwise(of("R3", "supersede", "live"))
    return (
        F.when(F.coalesce(purged, F.lit(False)) if purged is not None else F.lit(False), of("R6", "supersede", "incoming"))
        .when((incoming == 4) & (live == 4), later).when(incoming == 4, of("R5", "supersede", "incoming")).when(live == 4, of("R1", "skip"))
        .when((incoming == 1) & (live >= 2), of("R2", "skip")).when(incoming > live, of("R1", "supersede", "incoming")).when(incoming < live, of("R1", "skip"))
        .when((live <= 2) & (margin < MARGIN - 2.220446049250313e-16), of("R4", "contested")).otherwise(later)
    )


def enriched(claims: DataFrame, parts: int | None = None) -> DataFrame:
    """(claim_id, conflict): present where another claim of the key disagrees and may hold at the same time, unknown where
    the claim's own time isn't known, else none_observed.  An unknown start overlaps everything."""
    known = claims.withColumns({"valid_from": F.coalesce("valid_from", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))), "valid_to": F.when(F.col("valid_from").isNotNull(), F.col("valid_to"))})
    pairs = conflicts(known, parts)
    met = pairs.select(F.col("a.claim_id").alias("claim_id")).unionByName(pairs.select(F.col("b.claim_id").alias("claim_id"))).distinct().withColumn("met", F.lit(True))
    state = F.when(F.col("met"), "present").when(F.col("valid_from").isNull(), "unknown").otherwise("none_observed")
    return claims.join(met, "claim_id", "left").select("claim_id", state.alias("conflict"))


def authority(intent: Column, producer: Column, quoted: Column, taints: Column, connectors: Column, corroborated: Column) -> Column:
    """The tier of a claim's author, struct(tier, cap, relayed).  ``taints`` and ``connectors`` are arrays over its
    events.  One untrusted event without a second witness makes an inference with a confidence of 0.5 at most; an agent
    relays no more than evidence, unless it relays a correction."""
    agent = F.startswith(producer, F.lit("agent:"))
    model = agent | (producer == "model")
    base = (
        F.when(intent == "correct", 4).when(producer == "owner", 3).when(model, F.when(quoted, 2).otherwise(1))
        .when((F.size(taints) > 0) & F.forall(taints, lambda t: t == "owner"), 3).otherwise(2)
    )
    single = (F.size(taints) == 1) & (F.element_at(taints, 1) == "untrusted") & ~corroborated & (F.size(F.array_distinct(connectors)) <= 1) & (intent != "correct") & (base < 3)
    tier = F.when(single, 1).otherwise(base)
    relayed = F.when(agent & (intent != "correct"), F.least(tier, F.lit(2))).otherwise(tier)
    return F.struct(relayed.cast("int").alias("tier"), F.when(single, 0.5).otherwise(1.0).alias("cap"), agent.alias("relayed"))


def kept_first(claims: DataFrame, group: list[str], priority: Column, *then: str) -> DataFrame:
    """Of each group the row that comes first by priority, then by the columns named."""
    return claims.groupBy(*group).agg(F.min_by(F.struct(*claims.columns), F.struct(priority, *then)).alias("r")).select("r.*")


def gaps(claims: DataFrame) -> DataFrame:
    """Times that no claim of a key covers, between its first start and its last."""
    w = Window.partitionBy("claim_key").orderBy("valid_from", "claim_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = claims.withColumn("gap_from", F.max(_end(F.col("valid_to"))).over(w))
    return prior.where(F.col("gap_from") < F.col("valid_from")).select("claim_key", "gap_from", F.col("valid_from").alias("gap_to"))


def superseded(claims: DataFrame) -> DataFrame:
    """Each claim's end, cut where the key's next claim starts."""
    nxt = F.lead("valid_from").over(Window.partitionBy("claim_key").orderBy("valid_from", "claim_id"))
    return claims.withColumn("ends", F.least("valid_to", nxt)).withColumn("replaced", nxt.isNotNull())


def corroboration(witnesses: DataFrame, claim: str, root: str, strength: str) -> DataFrame:
    """Independent roots of each claim, its best strength, and whether it holds (two roots or more)."""
    return witnesses.groupBy(claim).agg(F.countDistinct(root).alias("n_roots"), F.max(strength).alias("best")).withColumn("held_back", F.col("n_roots") < 2)


def known_as_of(history: DataFrame, key: str, sequence: str, cutoff: int, *state: str) -> DataFrame:
    """Each key's last state with a sequence up to the cutoff."""
    return history.where(F.col(sequence) <= cutoff).groupBy(key).agg(F.max_by(F.struct(sequence, *state), sequence).alias("s")).select(key, "s.*")


def supported_by_all(supports: DataFrame, claim: str, ok: Column) -> DataFrame:
    """Claims all of whose supports are fit to be shown."""
    return supports.groupBy(claim).agg(F.count(F.lit(1)).alias("n_supports"), F.bool_and(ok).alias("fit")).where("fit").drop("fit")


def conflict_groups(claims: DataFrame, page: int = 32) -> DataFrame:
    """claim_key, place, claim_id: claims that a live one of their key disagrees with, in groups; keys with the newest claim
    first, a page of them.  ``claims`` adds asserted_at."""
    pairs = conflicts(claims)
    met = pairs.select(F.col("a.claim_key").alias("claim_key"), F.explode(F.array("a.claim_id", "b.claim_id")).alias("claim_id")).distinct()
    held = met.join(claims.select("claim_id", "asserted_at"), "claim_id")
    keys = held.groupBy("claim_key").agg(F.max("asserted_at").alias("newest")).orderBy(F.desc("newest"), "claim_key").limit(page)
    placed = keys.withColumn("place", F.row_number().over(Window.orderBy(F.desc("newest"), "claim_key")))  # a page
    return held.join(F.broadcast(placed), "claim_key").select("claim_key", "place", "claim_id")


def intersections(rows: DataFrame, key: str, id_: str, starts: str, ends: str) -> DataFrame:
    """old_id, new_id, starts, ends: pairs of a key's intervals that overlap, and where.  A hot key's pairs are spread as
    in ``conflicts``."""
    base = rows.select(F.col(key).alias("claim_key"), F.col(id_).alias("claim_id"), F.col(starts).alias("valid_from"), F.col(ends).alias("valid_to"), F.col(id_).cast("string").alias("object"))
    both = conflicts(base)
    return both.select(F.col("a.claim_id").alias("old_id"), F.col("b.claim_id").alias("new_id"), F.greatest("a.valid_from", "b.valid_from").alias("starts"), F.least(_end(F.col("a.valid_to")), _end(F.col("b.valid_to"))).alias("ends"))


#: Predicates that say who is who, and pieces of words that give a statement authority (fixed values).
IDENTITY = ("identity.same_as", "identity.handle_on")
AUTHORITY_TERMS = ("owner", "agent", "assistant", "grant", "permission", "authoriz", "authoris", "access", "polic", "admin", "credential", "audit", "revok")


def held(claims: DataFrame, supports: DataFrame, least: int = 2) -> DataFrame:
    """Claims that wait for a further witness: on identity, decisions of authority, or backed by words of authority, without
    an owner's support and with fewer than ``least`` sources.  ``claims``: claim_id, predicate, object.  ``supports``, those
    the reader may use: claim_id, source, owner, body."""
    heavy = lambda c: F.rlike(F.lower(F.coalesce(c, F.lit(""))), F.lit("|".join(AUTHORITY_TERMS)))
    s = supports.groupBy("claim_id").agg(F.countDistinct("source").alias("roots"), F.bool_or("owner").alias("owned"), F.bool_or(heavy(F.col("body"))).alias("said"))
    weighty = F.col("predicate").isin(*IDENTITY) | (F.startswith("predicate", F.lit("decision.")) & heavy(F.col("object")))
    met = claims.join(s, "claim_id", "left")
    waits = (weighty | F.coalesce("said", F.lit(False))) & ~F.coalesce("owned", F.lit(False)) & (F.coalesce("roots", F.lit(0)) < least)
    return met.where(waits).select("claim_id")


def field_changes(old: DataFrame, new: DataFrame, key: str, *fields: str, most: int = 128) -> DataFrame:
    """key, change, fields, truncated: added, removed and changed keys, with the fields that differ; of each kind the first
    ``most`` by key, and whether any kind has more."""
    before, after = (x.select(key, F.struct(*fields).alias(n)) for x, n in ((old, "o"), (new, "n")))
    both = before.join(after, key, "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(differ) > 0, "changed")
    rows = both.select(key, change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("fields")).where("change IS NOT NULL")
    kept = rows.withColumn("place", F.row_number().over(Window.partitionBy("change").orderBy(key))).where(F.col("place") <= most + 1)
    more = kept.agg(F.coalesce(F.max("place") > most, F.lit(False)).alias("truncated"))
    return kept.where(F.col("place") <= most).drop("place").crossJoin(F.broadcast(more))


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed keys between two views."""
    a, b = old.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    added = b.join(a, key, "left_anti").select(key, F.lit("added").alias("change"))
    removed = a.join(b, key, "left_anti").select(key, F.lit("removed").alias("change"))
    changed = a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after"))).select(key, F.lit("changed").alias("change"))
    return added.unionByName(removed).unionByName(changed)


def brier(forecasts: DataFrame, by: str, probability: Column, outcome: Column, least: int = 20) -> DataFrame:
    """Mean square error of resolved forecasts (columns resolved, censored), none below ``least`` of them, how many are
    resolved, censored and open, and how many were certain and wrong."""
    certain_wrong = ((probability == 1) & (outcome == 0)) | ((probability == 0) & (outcome == 1))
    n = lambda c: F.count(F.when(c, 1))
    done = F.col("resolved")
    error = F.avg(F.when(done, (probability - outcome) * (probability - outcome)))
    return forecasts.groupBy(by).agg(
        n(done).alias("n_resolved"), n(~done & F.col("censored")).alias("n_censored"), n(~done & ~F.col("censored")).alias("n_open"),
        F.when(n(done) >= least, error).alias("brier"), n(done & certain_wrong).alias("certain_wrong"),
    )
