"""States of the belief graph: outcomes, commitments, questions, forecasts, skills, perspectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalar import micros


def valid_at(claims: DataFrame, at: str | None = None, until: str | None = None, unknown: bool = False) -> DataFrame:
    """Claims by valid time: all, only those whose start is unknown, those that hold at an instant, or at some time of a
    span.  Intervals are half-open, a null end is open."""
    if unknown:
        return claims.where("valid_from IS NULL")
    if at is None:
        return claims
    t = F.to_timestamp_ntz(F.lit(at))
    ends = F.col("valid_to").isNull() | (F.col("valid_to") > t)
    if until is None:
        return claims.where((F.col("valid_from") <= t) & ends)
    return claims.where((F.col("valid_from") < F.to_timestamp_ntz(F.lit(until))) & ends)


def typed(claims: DataFrame, kinds: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """Typed claims of these kinds, asserted within a grant's times (both inclusive)."""
    out = claims.where(F.coalesce("typed", F.lit(False)))
    out = out.where(F.col("kind").isin(*kinds)) if kinds else out
    out = out.where(F.col("asserted_at") >= F.to_timestamp_ntz(F.lit(since))) if since else out
    return out.where(F.col("asserted_at") <= F.to_timestamp_ntz(F.lit(until))) if until else out


def deadline(due: Column) -> Column:
    """A date is due at the end of its UTC day; an instant is itself; anything else is null."""
    date = F.when(F.rlike(due, F.lit(r"^\d{4}-\d\d-\d\d$")), F.concat(due, F.lit(" 23:59:59.999")))
    return F.coalesce(date, F.when(F.rlike(due, F.lit(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d")), F.regexp_replace(due, "T", " "))).try_cast("timestamp_ntz")


def overdue(dues: Column, at: Column) -> Column:
    """yes, no or unknown for an array of due texts.  Several that differ, or one that is no date, make it unknown; a date
    is overdue only on a later UTC day."""
    one = F.array_distinct(dues)
    value = F.element_at(one, 1)
    date = F.length(value) == 10
    late = F.when(date, F.date_format(at, "yyyy-MM-dd") > value).otherwise(at > deadline(value))
    known = (F.size(one) == 1) & deadline(value).isNotNull()
    return F.when(F.coalesce(known, F.lit(False)), F.when(late, "yes").otherwise("no")).otherwise("unknown")


def commitment_status(statements: DataFrame, key: str) -> DataFrame:
    """The status of each commitment from its statements (status, owner, asserted): an owner's open or dropped settles it;
    an owner's done does unless someone says otherwise; done as others say is a claim; dropped counts where all say so."""
    said = lambda s, who=None: F.bool_or((F.col("status") == s) & F.col("asserted") & (F.col("owner") if who else F.lit(True)))
    done = F.bool_or(F.col("status").isin("done", "claimed_done"))
    g = statements.groupBy(key).agg(
        said("open", 1).alias("o_open"), said("dropped", 1).alias("o_dropped"), said("done", 1).alias("o_done"), said("open").alias("open"), said("dropped").alias("dropped"),
        done.alias("done"), F.countDistinct(F.when(F.col("asserted") | F.col("status").isin("done", "claimed_done"), F.col("status"))).alias("n_values"),
    )
    status = (
        F.when(F.col("o_open"), "open").when(F.col("o_dropped"), "dropped").when(F.col("o_done") & ~F.col("dropped") & ~F.col("open"), "done")
        .when((F.col("n_values") == 1) & F.col("dropped"), "dropped").when(F.col("done"), "claimed_done").otherwise("open")
    )
    return g.select(key, status.alias("status"), (F.col("n_values") > 1).alias("uncertain"))


def question_status(statements: DataFrame, key: str) -> DataFrame:
    """The state of each question.  ``statements``: key, kind (status or answer), value, owner, roots, conflict.  In order:
    abandoned; reopened, or resolved with an opposed answer, or a good answer that is opposed; resolved; partial; with
    no owner's open, resolved by a good unopposed answer; open.  Good is an owner's answer or one of two roots."""
    by_owner = (F.col("kind") == "status") & F.col("owner")
    has = lambda v: F.coalesce(F.bool_or(by_owner & (F.col("value") == v)), F.lit(False))
    answer = F.col("kind") == "answer"
    good = answer & (F.col("owner") | (F.col("roots") >= 2))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = statements.groupBy(key).agg(
        *(has(v).alias(v) for v in ("abandoned", "reopened", "resolved", "partial", "open")),
        some(answer & (F.col("conflict") == "present")).alias("opposed"), some(good & (F.col("conflict") == "present")).alias("good_opposed"),
        some(good & (F.col("conflict") == "none_observed")).alias("backed"),
    )
    status = (
        F.when(F.col("abandoned"), "abandoned").when(F.col("reopened") | (F.col("resolved") & F.col("opposed")) | F.col("good_opposed"), "reopened")
        .when(F.col("resolved"), "resolved").when(F.col("partial"), "partial").when(~F.col("open") & F.col("backed"), "resolved").otherwise("open")
    )
    return g.select(key, status.alias("status"))


def frontier(questions: DataFrame, key: str) -> DataFrame:
    """(gap, question): what is open, what is contradicted, and the gaps named (array ``gaps``), each question once a gap."""
    own = F.when(F.col("status").isin("open", "partial"), F.array(F.lit("unresolved_question"))).when(F.col("status") == "reopened", F.array(F.lit("contradiction"))).otherwise(F.array().cast("array<string>"))
    return questions.select(F.explode(F.array_distinct(F.concat(own, "gaps"))).alias("gap"), F.col(key).alias("question"))


def skill_evidence(claims: DataFrame) -> DataFrame:
    """The class of each piece of evidence of a skill: an observed outcome that is not independent is a self report."""
    return claims.withColumn("class", F.when((F.col("evidence") == "observed_outcome") & ~F.col("independent"), "self_report").otherwise(F.col("evidence")))


def perspectives(relations: DataFrame, subject: str) -> DataFrame:
    """Relations of each person by who holds, who says, and how; names and kinds aside.  Nulls are a value."""
    rest = relations.where(~F.col("predicate").isin("world.kind", "person.label"))
    return rest.groupBy(subject, "holder", "speaker", "mode").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("predicate")).alias("predicates"))


def assistance(facets: DataFrame, evidence: DataFrame) -> DataFrame:
    """(facet_id, assistance): what is said, of the actor and the task of a facet and of a time that may overlap, on whether
    there was help.  One value, all of it asserted and nothing of it opposed, says; else unknown.  ``facets``: facet_id,
    actor, task, valid_from, valid_to.  ``evidence``: actor, task, value, sure, valid_from, valid_to."""
    f, e = facets.alias("f"), evidence.alias("e")
    apart = (F.col("e.valid_to") <= F.col("f.valid_from")) | (F.col("f.valid_to") <= F.col("e.valid_from"))
    on = (F.col("f.actor") == F.col("e.actor")) & (F.col("f.task") == F.col("e.task")) & ~F.coalesce(apart, F.lit(False))
    got = f.join(e, on, "left").groupBy("f.facet_id").agg(F.countDistinct("e.value").alias("n"), F.min("e.value").alias("v"), F.coalesce(F.bool_and("e.sure"), F.lit(False)).alias("sure"))
    return got.select("facet_id", F.when(F.col("sure") & (F.col("n") == 1) & F.col("v").isin("assisted", "unassisted"), F.col("v")).otherwise("unknown").alias("assistance"))


def outcomes(entries: DataFrame, *conditions: str) -> DataFrame:
    """What became of each report, with its conditions.  ``entries``: stage (reported, observed, reviewed), result, root, at,
    confounded, and the condition columns.  Met: the latest independent observation met it, the latest independent review
    accepted, and none said otherwise; not met: the latest of both say so; anything confounded is unknown.  An entry is
    independent if none of the reports with those conditions has its root."""
    reports = entries.where("stage = 'reported'").groupBy(*conditions).agg(F.collect_set("root").alias("roots"), F.bool_or("confounded").alias("blurred"))
    others = entries.where("stage <> 'reported'").join(reports, list(conditions)).where(~F.array_contains("roots", F.col("root")))
    of = lambda stage, value: F.when(F.col("stage") == stage, value)
    when = F.struct("at", "root")
    seen = others.groupBy(*conditions).agg(
        F.max_by(of("observed", F.col("result")), of("observed", when)).alias("observation"), F.max_by(of("reviewed", F.col("result")), of("reviewed", when)).alias("review"),
        F.bool_or(F.col("result").isin("not_met", "rejected")).alias("negative"), F.bool_or("confounded").alias("blurred_too"),
    )
    clear = ~F.col("blurred") & ~F.coalesce("blurred_too", F.lit(False))
    met = (F.col("review") == "accepted") & (F.col("observation") == "met") & ~F.coalesce("negative", F.lit(False))
    missed = (F.col("observation") == "not_met") & (F.col("review") == "rejected")
    result = F.when(clear & met, "met").when(clear & missed, "not_met").otherwise("unknown")
    return reports.join(seen, list(conditions), "left").select(*conditions, result.alias("result"))


def forecasts(dues: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """(item, due, probability): a quarter where something it needs is due later, else a half.  No forecast for an item that
    is settled, or whose dues, or those of a prerequisite, are missing or differ.  ``dues``: item, due, settled.
    ``prerequisites``: item, needs."""
    own = dues.groupBy("item").agg(F.countDistinct("due").alias("n"), F.min("due").alias("due"), F.bool_or("settled").alias("settled"), F.bool_or(F.col("due").isNull()).alias("open"))
    sure = own.where("n = 1 AND NOT open").select("item", "due", "settled")
    needs = prerequisites.join(sure.select(F.col("item").alias("needs"), F.col("due").alias("needs_due")), "needs", "left")
    needs = needs.groupBy("item").agg(F.max("needs_due").alias("latest"), F.bool_or(F.col("needs_due").isNull()).alias("vague"))
    met = sure.where("NOT settled").join(needs, "item", "left").where("NOT coalesce(vague, false)")
    return met.select("item", "due", F.when(F.col("latest") > F.col("due"), 0.25).otherwise(0.5).alias("probability"))


def forecast_resolution(forecasts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(forecast_id, status): from the first piece of evidence between freezing and now that can settle it.  ``forecasts``:
    forecast_id, item, due, frozen_at.  ``evidence``: item, at, done_at, what (done, dropped, met, not_met).  Dropped is
    censored.  A met inspection counts up to the due time only; a failed one settles nothing, as it may be met in time
    still; done says itself when it was done.  Without such evidence the forecast is open."""
    f, e = forecasts.alias("f"), evidence.alias("e")
    said = F.when(F.col("what") == "dropped", "censored").when((F.col("what") == "done") & (F.col("done_at") <= F.col("e.at")), F.when(F.col("done_at") <= F.col("due"), "resolved_met").otherwise("resolved_not_met"))
    said = said.when((F.col("what") == "met") & (F.col("e.at") <= F.col("due")), "resolved_met")
    rows = f.join(e, (F.col("f.item") == F.col("e.item")) & (F.col("e.at") >= F.col("frozen_at")), "left").select("forecast_id", F.col("e.at").alias("at"), said.alias("said"))
    first = rows.groupBy("forecast_id").agg(F.min(F.when(F.col("said").isNotNull(), F.struct("at", "said"))).alias("s"))
    return first.select("forecast_id", F.coalesce("s.said", F.lit("open")).alias("status"), F.col("s.at").alias("resolved_at"))


def attention(cues: DataFrame, snoozed: DataFrame, now: Column, key: str, most: int = 16) -> DataFrame:
    """Cues (key, cue) by urgency, without those snoozed until later than now (key, until)."""
    rank = F.when(F.col("cue") == "blocker", 1).when(F.col("cue") == "due", 2).when(F.col("cue") == "uncertainty", 3).otherwise(4)
    asleep = snoozed.where(F.col("until") > now).select(key)
    return cues.join(asleep, key, "left_anti").withColumn("rank", rank).orderBy("rank", key).limit(most)


def expired(views: DataFrame, made_at: str, now: Column) -> DataFrame:
    """Views that have outlived the time their kind lasts (fixed values, in seconds)."""
    lasts = {"view": 900, "packet": 900, "resume": 86_400, "consolidation": 604_800}
    seconds = F.create_map(*(x for k, v in lasts.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    age = micros(now) - micros(F.col(made_at))
    return views.where(age >= 1_000_000 * F.coalesce(F.try_element_at(seconds, F.col("kind")), F.lit(0)))


def chosen_page(candidates: DataFrame, group: str) -> DataFrame:
    """The page that a claim is written to: one it is bound to before one named before one of its subject, then the highest
    tier, the oldest, the smallest id."""
    via = F.when(F.col("via") == "bound", 0).when(F.col("via") == "explicit", 1).otherwise(2)
    return candidates.groupBy(group).agg(F.min_by("page_id", F.struct(via, -F.col("tier"), "created_at", "page_id")).alias("page_id"))
