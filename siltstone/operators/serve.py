"""What a reader is shown: documents of pages and events, search over them with its labels, pages, entities, evidence.

Everything that leaves goes through redaction, and a hit is matched again in
the text that is released: a word that redaction took out finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalar import SENSITIVITY, redacted
from siltstone.operators import search as Q

#: Kinds of pages that are entities (fixed values).
ENTITIES = ("person", "organization", "project", "place", "concept")
#: Characters of a page's body, of an entity's excerpt.
BODY, EXCERPT = 65_536, 280

COLUMNS = ("doc_id", "scope", "title", "body", "path", "page_type", "sensitivity", "taint", "authority", "occurred_at", "connector", "subjects", "provenance")


def label(hint: Column) -> Column:
    """A sensitivity label, or unlabeled."""
    return F.when(hint.isin(*SENSITIVITY), hint).otherwise("unlabeled")


def documents(pages: DataFrame, events: DataFrame) -> DataFrame:
    """COLUMNS of both.  ``pages``: id, title, body, path, type, sensitivity, taint, authority, subjects, sources.
    ``events``: event_id, connector, kind, text, hint, occurred_at, subjects.  An event is quoted evidence of its connector."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    canon = pages.select(
        F.concat(F.lit("page:"), F.col("id").cast("string")).alias("doc_id"), F.lit("canon").alias("scope"), text("title").alias("title"), text("body").alias("body"), text("path").alias("path"), text("type").alias("page_type"),
        label(F.col("sensitivity")).alias("sensitivity"), F.when(F.col("taint") == "quoted", "quoted").otherwise("clean").alias("taint"), "authority", F.lit(None).cast("timestamp_ntz").alias("occurred_at"), F.lit("").alias("connector"),
        F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), F.coalesce("sources", F.array().cast("array<string>")).alias("provenance"),
    )
    name = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    ledger = events.select(
        name.alias("doc_id"), F.lit("ledger").alias("scope"), F.concat_ws(" ", "connector", "kind").alias("title"), text("text").alias("body"), F.lit("").alias("path"), F.col("kind").alias("page_type"), label(F.col("hint")).alias("sensitivity"),
        F.lit("quoted").alias("taint"), F.lit("connector_evidence").alias("authority"), F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "connector", F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), F.array(name).alias("provenance"),
    )
    return canon.unionByName(ledger)


def coverage(query: str, title: Column, body: Column) -> Column:
    """1 where the words asked for stand in what is released, the share of a question's words where enough do, else 0."""
    parts = Q.parse_query(query)
    if not parts:
        return F.lit(0.0)
    whole = reduce(lambda x, y: x & y, (Q.spans(title, p, q) + Q.spans(body, p, q) > 0 for p, q in parts))
    terms, need = Q.relaxed_terms(query)
    if not terms:
        return F.when(whole, 1.0).otherwise(0.0)
    held = lambda form: Q.spans(title, form.rstrip("*"), form.endswith("*")) + Q.spans(body, form.rstrip("*"), form.endswith("*")) > 0
    found = sum((reduce(lambda x, y: x | y, map(held, t)).cast("int") for t in terms), F.lit(0))
    return F.when(whole, 1.0).when(found >= need, found / len(terms)).otherwise(0.0)


def search(docs: DataFrame, query: str, ceiling: int, limit: int | None = 50, scope: str = "all", types: tuple[str, ...] | None = None, subjects: tuple[str, ...] | None = None, since: str | None = None, until: str | None = None, degraded: tuple[str, ...] = (), seeds: bool = True) -> tuple[DataFrame, list[str]]:
    """Hits (doc_id, exact, score, coverage, excerpt) and labels.  What the reader may not see, and what the question leaves
    out, is no candidate.  A time bound asks events alone.  A question with few literal hits is asked again for most of
    its words.  Hits that the redacted text does not bear out are dropped; ``seeds`` as in ``redacted``.  Without a
    ``limit`` all hits come, in no order, and each task redacts its own."""
    labels = list(degraded)
    empty = docs.sparkSession.createDataFrame([], "doc_id string, exact boolean, score double, coverage double, excerpt string")
    if not Q.parse_query(query):
        return empty, ["query-empty"]
    if limit == 0 or types == () or subjects == ():
        return empty, [*labels, "scope-empty"]
    rank = F.create_map(*(F.lit(x) for kv in SENSITIVITY.items() for x in kv))
    seen = docs.where(F.coalesce(F.try_element_at(rank, F.col("sensitivity")), F.lit(len(SENSITIVITY))) <= ceiling)
    seen = seen if scope == "all" else seen.where(F.col("scope") == scope)
    seen = seen if types is None else seen.where(F.col("page_type").isin(*types))
    seen = seen if subjects is None else seen.where(F.arrays_overlap("subjects", F.array(*map(F.lit, subjects))))
    if since or until:
        seen = seen.where("scope = 'ledger'")
        labels += [] if scope == "ledger" else ["canon-time-scope-unsupported"]
        seen = seen.where(F.col("occurred_at") >= F.to_timestamp_ntz(F.lit(since))) if since else seen
        seen = seen.where(F.col("occurred_at") < F.to_timestamp_ntz(F.lit(until))) if until else seen
    found = Q.literal(seen, query, "title", "body", "doc_id", limit)
    terms, need = Q.relaxed_terms(query)
    if terms and found.limit(Q.BELOW).count() < Q.BELOW:
        labels.append("query-relaxed")
        found = Q.relaxed(seen, terms, need, "body")
        found = found.orderBy(F.desc("covered"), "doc_id").limit(limit) if limit is not None else found
        found = found.withColumns({"exact": F.lit(False), "score": F.col("coverage")})
    # what a generator made is not written out again for each word that is looked for in it
    shown = found.select("doc_id", "exact", "score", F.inline(F.array(F.struct(redacted(F.col("title"), seeds).alias("title"), redacted(F.col("body"), seeds).alias("body")))))
    words = [w for p, _ in Q.parse_query(query) for w in p.split()]
    kept = shown.withColumn("coverage", coverage(query, F.col("title"), F.col("body"))).where("coverage > 0").select("doc_id", "exact", F.col("score").cast("double").alias("score"), F.col("coverage").cast("double").alias("coverage"), Q.snippet(F.col("body"), words).alias("excerpt"))
    return kept, [*labels, *(["query-no-match"] if "query-relaxed" in labels and kept.isEmpty() else [])]


def page(pages: DataFrame, ceiling: int, id: str | None = None, path: str | None = None) -> DataFrame:
    """id, reason, excerpt, truncated, length of the one page asked for by id or path; no row where there is none, or it
    was retracted: both look alike.  ``reason`` says why it is withheld; ``length`` is that of the body as it is stored,
    before redaction and the cut.  ``pages`` adds retracted and rank, its label's."""
    if (id is None) == (path is None):
        raise ValueError("a page is asked for by its id or its path")
    found = pages.where(F.col("id") == id if path is None else F.col("path") == path).where(~F.coalesce("retracted", F.lit(False)))
    reason = F.when(F.col("rank").isNull(), "unlabeled").when(F.col("rank") > ceiling, "above_ceiling")
    body = redacted(F.col("body"))
    shown = reason.isNull()
    return found.select("id", reason.alias("reason"), F.when(shown, F.substring(body, 1, BODY)).alias("excerpt"), (shown & (F.length(body) > BODY)).alias("truncated"), F.when(shown, F.length("body")).alias("length"))


def entities(pages: DataFrame, ceiling: int, name: str | None = None, kind: str | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(served: id, title, excerpt; withheld: id, reason) of pages that are entities, in order of title and id.  ``name``
    is looked for in the title, the handle and the labels as they are served.  What is withheld counts beyond the limit.
    ``pages``: id, type, title, handle, labels, body, rank, retracted."""
    if kind is not None and kind not in ENTITIES:
        raise ValueError(f"{kind} is no kind of entity")
    rows = pages.where(F.col("type").isin(kind) if kind else F.col("type").isin(*ENTITIES)).where(~F.coalesce("retracted", F.lit(False))).withColumn("title", redacted(F.coalesce("title", F.lit(""))))
    if name is not None:
        want = F.lit(name.lower())
        near = lambda c: F.contains(F.lower(redacted(F.coalesce(c, F.lit("")))), want)
        rows = rows.where(F.contains(F.lower("title"), want) | near(F.col("handle")) | F.coalesce(F.exists("labels", near), F.lit(False)))
    denied = F.when(F.col("rank").isNull(), "unlabeled").when(F.col("rank") > ceiling, "above_ceiling")
    rows = rows.withColumn("reason", denied)
    line = F.trim(F.regexp_replace(redacted(F.coalesce("body", F.lit(""))), r"\s+", " "))
    served = rows.where("reason IS NULL").orderBy("title", "id").limit(limit).select("id", "title", F.substring(line, 1, EXCERPT).alias("excerpt"))
    return served, rows.where("reason IS NOT NULL").select("id", "reason")


def evidence(asked: DataFrame, anchors: DataFrame, events: DataFrame, seeds: bool = True) -> DataFrame:
    """claim_id, event_id, start, ends, offset, quote for each span asked for that is one of its support's anchors and that
    redaction does not cut through; ``offset`` counts in the redacted text.  All else has no row.  ``seeds`` as in ``redacted``.

    ``asked`` and ``anchors``: claim_id, event_id, start, ends (code points, end exclusive); ``events``: event_id, text."""
    keys = ["claim_id", "event_id", "start", "ends"]
    held = asked.join(anchors.select(*keys).distinct(), keys, "left_semi").join(events.select("event_id", "text"), "event_id")
    cut = lambda a, n: redacted(F.substr("text", a, n), seeds)
    one = F.lit(1)
    before, inside, behind = cut(one, F.col("start")), cut(F.col("start") + 1, F.col("ends") - F.col("start")), cut(F.col("ends") + 1, F.length("text"))
    parts = held.withColumns({"before": before, "quote": inside, "behind": behind, "whole": redacted(F.col("text"), seeds)})
    fair = (F.concat("before", "quote", "behind") == F.col("whole")) & (F.length("quote") > 0)
    return parts.where(fair).select(*keys, F.length("before").alias("offset"), "quote")


def mode_labels(mode: str, space: str | None, indexed: str | None, backlog: int, lexical_hits: int) -> list[str]:
    """What a mode of retrieval (lexical, vector, hybrid) lacks: no vectors asked for or to be had, vectors of another
    space, documents that still wait for theirs, no hit by words."""
    if mode not in ("lexical", "vector", "hybrid"):
        raise ValueError(f"{mode} is no mode of retrieval")
    out = []
    if mode != "vector" and not lexical_hits:
        out.append("keyword-zero")
    if mode == "lexical":
        return out
    if space is None or indexed is None:
        return ["vector-skipped", *out]
    if space != indexed:
        return ["embedding-space-mismatch", *out]
    return [*(["vector-backlog"] if backlog else []), *out]
