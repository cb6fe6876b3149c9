"""Claims filed one after another: the fold that decides what each arrival does.

What a claim does depends on those before it that are still live: one that says
the same of an overlapping time is corroborated by it, those that it contradicts
win, lose or stand beside it.  Only claims of one key whose times overlap meet,
so a key falls into components: runs of claims joined by overlap, found by a
running maximum of ends over (key, start) that no hot key stops.  Components
with a body in common are one, as an exact repeat is known whatever its time.
Each is folded in order of arrival by a task that streams its rows and holds the
claims that are live, no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.scalar import AUTHORITY, SENSITIVITY, content_hash, normalized_object
from siltstone.operators import graph
from siltstone.operators.claims import FAR, MARGIN, SINGLE_VALUED, authority
from siltstone.operators.scan import RANGE, ranged, running
from siltstone.operators.shared import written

#: Claims that a component holds at once, at most; arrivals beyond are returned as such, undecided.
LIVE = 1 << 20
#: A margin a rounding error below MARGIN still reaches it.
_CLOSE = MARGIN - 2.220446049250313e-16
_MODEL, _EVIDENCE, _CORRECTION = AUTHORITY["model_inference"], AUTHORITY["connector_evidence"], AUTHORITY["owner_correction"]


def components(claims: DataFrame, parts: int | None = None, bodies: bool = False) -> DataFrame:
    """``claims`` (claim_id, claim_key, valid_from, valid_to) with ``component``, a number; with ``bodies``, components that
    have a ``body`` (a hash) in common are one."""
    cut = ranged(claims, "claim_key", "valid_from", "claim_id", parts=parts)
    end = F.coalesce("valid_to", F.to_timestamp_ntz(F.lit(FAR)))
    swept = running(cut, ("claim_key",), ("valid_from", "claim_id"), ("_reach", "max", end), upto=-1)
    begins = F.col("claim_key").isNull() | F.col("_reach").isNull() | (F.col("_reach") <= F.col("valid_from"))
    swept = swept.withColumn("_begins", begins.cast("long"))
    found = running(swept, (), ("claim_key", "valid_from", "claim_id"), ("component", "sum", F.col("_begins"))).drop(RANGE, "_reach", "_begins")
    if not bodies:
        return found
    said = found.where("body IS NOT NULL").groupBy("claim_key", "body", "component").agg(F.lit(1)).select("claim_key", "body", F.col("component").alias("b"))
    least = said.groupBy("claim_key", "body").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = said.join(least, ["claim_key", "body"]).where("a <> b").select("a", "b").distinct()
    joined = graph.clusters(links).select(F.col("node").alias("component"), "cluster")
    return found.join(joined, "component", "left").withColumn("component", F.coalesce("cluster", "component")).drop("cluster")


def _overlap(a: dict, b: dict) -> bool:
    return (b["valid_to"] is None or a["valid_from"] < b["valid_to"]) and (a["valid_to"] is None or b["valid_from"] < a["valid_to"])


def decide(new: dict, old: dict) -> tuple[str, str]:
    """(rule, what happens to the incoming claim or the live one: skip, contest, replace)."""
    if old["purged"]:
        return "R6", "replace"
    a, b = new["tier"], old["tier"]
    if a != b:
        rule = "R5" if a == _CORRECTION else "R2" if a == _MODEL and b >= _EVIDENCE and b != _CORRECTION else "R1"
        return rule, "replace" if a > b else "skip"
    newer = (new["valid_from"], new["confidence"], new["claim_id"]) > (old["valid_from"], old["confidence"], old["claim_id"])
    margin = new["confidence"] - old["confidence"] if newer else old["confidence"] - new["confidence"]
    if a <= _EVIDENCE and margin < _CLOSE:
        return "R4", "contest"
    return "R3", "replace" if newer else "skip"


class Component:
    """The live claims of a component, by id in order of arrival, and the bodies ever filed in it."""

    def __init__(self, most: int = LIVE):
        self.most, self.live, self.bodies = most, {}, {}

    def file(self, c: dict) -> Iterator[dict]:
        """Take one claim in; yields those that are done with: itself unless it lives, and what it replaced."""
        if len(self.live) + len(self.bodies) > self.most:
            yield c | {"outcome": "beyond", "status": None}
            return
        exact = self.bodies.get(c["body"]) if c["body"] is not None else None
        if exact is not None:
            if not c["dry"]:
                exact["sensitivity"] = max(exact["sensitivity"], c["sensitivity"])
            yield c | {"outcome": "duplicate", "status": None, "met": exact["claim_id"]}
            return
        near = [x for x in self.live.values() if _overlap(c, x)] if c["claim_key"] is not None else []
        same = next((x for x in near if x["polarity"] == c["polarity"] and x["object"] == c["object"] and not x["purged"]), None)
        if same is not None:
            if not c["dry"]:
                self._corroborate(same, c)
            yield c | {"outcome": "duplicate", "status": None, "met": same["claim_id"]}
            return
        against = [(x, *decide(c, x)) for x in near if x["polarity"] != c["polarity"] or (c["single"] and x["object"] != c["object"])]
        lost = next(((x, rule) for x, rule, what in against if what == "skip"), None)
        if lost is not None:
            row = c | {"outcome": "skipped", "status": "skipped", "met": lost[0]["claim_id"], "rule": lost[1]}
            if c["body"] is not None and not c["dry"]:
                self.bodies[c["body"]] = row
            yield row
            return
        even = [x["claim_id"] for x, _, what in against if what == "contest"]
        row = c | {"outcome": "contested" if even else "stored", "status": "live", "met": even[-1] if even else None, "replaced": sum(what == "replace" for *_, what in against)}
        if c["dry"]:
            yield row | {"status": None}
            return
        for x, rule, what in against:
            if what == "replace":
                ends = c["valid_from"] if x["valid_to"] is None else min(x["valid_to"], c["valid_from"])
                gone = self.live.pop(x["claim_id"])
                gone.update(status="purged" if x["purged"] else "superseded", by=c["claim_id"], rule=rule, valid_to=ends)
                yield gone
        self.live[c["claim_id"]] = row
        if c["body"] is not None:
            self.bodies[c["body"]] = row

    @staticmethod
    def _corroborate(x: dict, c: dict) -> None:
        """New evidence confirms; a new root is a further witness; the label only tightens."""
        x["sensitivity"] = max(x["sensitivity"], c["sensitivity"])
        if set(c["provenance"]) <= set(x["provenance"]):
            return
        x["corroboration"] += bool(set(c["roots"]) - set(x["roots"]))
        x["confidence"], x["tier"] = max(x["confidence"], c["confidence"]), max(x["tier"], c["tier"])
        x["provenance"] = list(dict.fromkeys([*x["provenance"], *c["provenance"]]))
        x["roots"] = list(dict.fromkeys([*x["roots"], *c["roots"]]))


def _shaped(claims: DataFrame) -> DataFrame:
    """All columns that the fold reads, those that are missing by default."""
    own = F.array(F.col("claim_id").cast("string"))
    default = {
        "object": F.lit(None).cast("string"), "polarity": F.lit("positive"), "single": F.lit(True), "purged": F.lit(False), "dry": F.lit(False), "body": F.lit(None).cast("string"),
        "sensitivity": F.lit(SENSITIVITY["public"]), "provenance": own, "roots": own,
    }
    for name, value in default.items():
        if name not in claims.columns:
            claims = claims.withColumn(name, value)
    return claims.select(
        "claim_id", "claim_key", normalized_object(F.col("object")).alias("object"), "polarity", "single", "valid_from", "valid_to", F.col("tier").cast("int").alias("tier"), F.col("confidence").cast("double").alias("confidence"),
        F.col("sensitivity").cast("int").alias("sensitivity"), F.col("provenance").cast("array<string>").alias("provenance"), F.col("roots").cast("array<string>").alias("roots"), "purged", "dry", "body",
    )


def filed(claims: DataFrame, most: int = LIVE, parts: int | None = None) -> DataFrame:
    """claim_id, outcome, status, met, by, rule, valid_to, tier, confidence, corroboration, sensitivity, provenance, replaced.

    ``claims``, in order of ``claim_id``: claim_key, valid_from, valid_to, tier, confidence; and, where they are not all
    alike, object, polarity, single (its predicate holds one value), provenance and roots (arrays), sensitivity, purged
    (its evidence is gone), body (a hash) and dry.

    ``outcome`` is stored, contested (``met`` the last claim that stands beside it), skipped (``met`` what it lost to),
    duplicate (``met`` what it repeats) or beyond (the component holds more than ``most``); ``status`` what is left of it
    at the end: live, superseded or purged (``by`` whom, ``rule``, with its end cut), skipped, null if no row was made.
    A dry claim tells its outcome and changes nothing.  A claim without a key meets no other."""
    shaped = _shaped(claims)
    found = components(shaped, parts, "body" in claims.columns)
    id_type, at_type = (dict(shaped.dtypes)[c] for c in ("claim_id", "valid_from"))
    schema = StructType.fromDDL(
        f"claim_id {id_type}, outcome string, status string, met {id_type}, `by` {id_type}, rule string, valid_to {at_type}, tier int, confidence double, corroboration int, sensitivity int, provenance array<string>, replaced int"
    )

    def run(batches):
        held, now, out = None, None, []
        arrow = None

        def batch():
            columns = [[r.get(c) for r in out] for c in schema.names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=schema.names)

        for b in batches:
            kind = b.schema.field("claim_id").type
            arrow = [kind, pa.string(), pa.string(), kind, kind, pa.string(), b.schema.field("valid_to").type, pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32()]
            for row in b.to_pylist():
                if row["component"] != now:
                    out += held.live.values() if held else ()
                    held, now = Component(most), row["component"]
                out += held.file(row | {"corroboration": 1})
                if len(out) >= 2000:
                    yield batch()
        if held:
            out += held.live.values()
        if out:
            yield batch()

    return found.repartition("component").sortWithinPartitions("component", "claim_id").mapInArrow(run, schema)


def requested(requests: DataFrame, existing: DataFrame, events: DataFrame, parts: int | None = None) -> DataFrame:
    """request_id, outcome, reason, met, replaced: proposals and corrections, filed in order of request_id behind ``existing``.

    ``requests``: request_id (above all claim ids), intent (propose or correct), producer, claim_key, predicate, object,
    polarity, valid_from, valid_to, confidence, provenance (ids of ``events``: event_id, root, taint, connector), dry.
    A request is refused where its provenance is empty or names an event that is not there; where a correction has no
    key (target_required); or where its key has no live claim before it (claim_unknown).  One that repeats the content of
    an earlier one is replayed and files nothing.  All others go through ``filed`` with the authority of their author,
    dry ones without effect."""
    parts_of = requests.select("request_id", F.explode_outer("provenance").alias("event_id"))
    seen = parts_of.join(events.select("event_id", "root", "taint", "connector"), "event_id", "left").groupBy("request_id").agg(
        F.bool_and(F.col("root").isNotNull()).alias("fit"), F.collect_set(F.col("root").cast("string")).alias("roots"), F.collect_set("taint").alias("taints"), F.collect_set("connector").alias("connectors"),
    )
    content = content_hash(*(F.col(c) for c in ("intent", "producer", "claim_key", "object", "polarity", "valid_from", "valid_to")))
    marked = requests.withColumn("hash", F.when(F.col("dry"), F.concat(F.lit("dry-"), F.col("request_id").cast("string"))).otherwise(content)).join(seen, "request_id", "left")
    first = marked.groupBy("hash").agg(F.min("request_id").alias("first"))
    marked = marked.join(first, "hash")
    said = F.col("intent") == "correct"
    reason = F.when(~F.coalesce("fit", F.lit(False)), "provenance").when(said & F.col("claim_key").isNull(), "target_required")
    marked = written(marked.withColumn("reason", reason), "requests")
    fit = marked.where("reason IS NULL AND request_id = first")
    tier = authority(F.col("intent"), F.col("producer"), F.lit(False), F.col("taints"), F.col("connectors"), F.lit(False))
    claims = fit.select(
        F.col("request_id").alias("claim_id"), "claim_key", "object", "polarity", F.col("predicate").isin(*SINGLE_VALUED).alias("single"), "valid_from", "valid_to",
        tier["tier"].alias("tier"), F.least(F.col("confidence").cast("double"), tier["cap"]).alias("confidence"), F.col("provenance").cast("array<string>").alias("provenance"), "roots", "dry",
    )
    # a correction needs something to correct: what stands before any request
    stands = filed(existing, parts=parts).where("status = 'live'").select("claim_id").join(existing.select("claim_id", "claim_key"), "claim_id").select("claim_key").distinct()
    blind = written(fit.where(said).join(stands, "claim_key", "left_anti").select(F.col("request_id").alias("claim_id")), "blind")
    done = filed(_shaped(existing).unionByName(_shaped(claims.join(blind, "claim_id", "left_anti"))), parts=parts).withColumnRenamed("claim_id", "request_id")
    met = marked.select("request_id", "first", "reason").join(done.select("request_id", "outcome", "met", "replaced"), "request_id", "left")
    met = met.join(blind.select(F.col("claim_id").alias("request_id"), F.lit(True).alias("blind")), "request_id", "left")
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("blind"), "claim_unknown")
    outcome = F.when(why.isNotNull(), "refused").when(F.col("request_id") != F.col("first"), "replayed").otherwise(F.col("outcome"))
    return met.select("request_id", outcome.alias("outcome"), why.alias("reason"), "met", "replaced")
