"""Queries over the write path: claims filed one after another, requests, and scans over the whole log."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import fold
from siltstone.operators import ledger as L
from siltstone.operators import scan
from siltstone.plans.catalog import _CLAIMS, _claims
from siltstone.plans.registry import query


def fold_sql(claims: str, tail: str) -> str:
    """The fold step by step: a key's claims in order of arrival, ``st`` being all that was filed under it.  ``claims`` adds
    roots, provenance (lists), sensitivity and dry."""
    meets = "x.status = 'live' AND (x.valid_to IS NULL OR c.valid_from < x.valid_to) AND (c.valid_to IS NULL OR x.valid_from < c.valid_to)"
    same = "x.polarity = c.polarity AND x.object IS NOT DISTINCT FROM c.object"
    later = "(c.valid_from > x.valid_from OR (c.valid_from = x.valid_from AND (c.confidence > x.confidence OR (c.confidence = x.confidence AND c.claim_id > x.id))))"
    close = f"CASE WHEN {later} THEN c.confidence - x.confidence ELSE x.confidence - c.confidence END < 0.15::DOUBLE - 2.220446049250313e-16"
    does = f"""CASE WHEN c.tier > x.tier THEN CASE WHEN c.tier = 4 THEN 'R5 replace' ELSE 'R1 replace' END WHEN c.tier < x.tier THEN CASE WHEN c.tier = 1 AND x.tier IN (2, 3) THEN 'R2 skip' ELSE 'R1 skip' END
 WHEN c.tier <= 2 AND {close} THEN 'R4 contest' WHEN {later} THEN 'R3 replace' ELSE 'R3 skip' END"""
    new = """{{'id': c.claim_id, 'object': c.object, 'polarity': c.polarity, 'valid_from': c.valid_from, 'valid_to': c.valid_to, 'tier': c.tier, 'confidence': c.confidence, 'sensitivity': c.sensitivity, 'roots': c.roots, 'provenance': c.provenance,
 'corroboration': 1, 'outcome': {0}, 'status': {1}, 'met': {2}, 'by': NULL::BIGINT, 'rule': {3}, 'replaced': {4}}}"""
    fresh = "len(list_filter(c.provenance, lambda p: NOT list_contains(x.provenance, p))) > 0"
    confirmed = f"""struct_update(x, sensitivity := greatest(x.sensitivity, c.sensitivity), corroboration := x.corroboration + CASE WHEN {fresh} AND len(list_filter(c.roots, lambda p: NOT list_contains(x.roots, p))) > 0 THEN 1 ELSE 0 END,
 confidence := CASE WHEN {fresh} THEN greatest(x.confidence, c.confidence) ELSE x.confidence END, tier := CASE WHEN {fresh} THEN greatest(x.tier, c.tier) ELSE x.tier END,
 roots := CASE WHEN {fresh} THEN list_distinct(list_concat(x.roots, c.roots)) ELSE x.roots END, provenance := CASE WHEN {fresh} THEN list_distinct(list_concat(x.provenance, c.provenance)) ELSE x.provenance END)"""
    named = "list_transform(list_filter(st, lambda x: {0}), lambda x: x.id)"
    step = f"""SELECT c.claim_key, c.k, st, c, {named.format(f"{meets} AND {same}")} AS twins, list_filter(list_transform(list_filter(st, lambda x: {meets} AND (x.polarity <> c.polarity OR (c.single AND x.object IS DISTINCT FROM c.object))), lambda x: {{'id': x.id, 'does': {does}}}), lambda x: true) AS met
 FROM r JOIN c ON c.claim_key = r.claim_key AND c.k = r.k + 1"""
    skipped = "list_filter(met, lambda m: m.does LIKE '%skip')"
    even = "list_filter(met, lambda m: m.does LIKE '%contest')"
    won = "list_filter(met, lambda m: m.does LIKE '%replace')"
    rule = f"list_filter({won}, lambda m: m.id = x.id)[1].does[1:2]"
    replaced = f"""struct_update(x, status := 'superseded', by := c.claim_id, rule := {rule}, valid_to := least(coalesce(x.valid_to, c.valid_from), c.valid_from))"""
    return f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY claim_id) AS k FROM ({claims})),
 r(claim_key, k, st) AS (SELECT claim_key, 0::BIGINT, list_filter([{new.format("''", "''", "NULL::BIGINT", "''", "0")}], lambda x: false) FROM c WHERE k = 1
 UNION ALL SELECT claim_key, k, CASE WHEN len(twins) > 0 THEN list_concat(list_transform(st, lambda x: CASE WHEN x.id = twins[1] AND NOT c.dry THEN {confirmed} ELSE x END), [{new.format("'duplicate'", "NULL::VARCHAR", "twins[1]", "NULL::VARCHAR", "NULL::INT")}])
 WHEN len({skipped}) > 0 THEN list_append(st, {new.format("'skipped'", "'skipped'", f"{skipped}[1].id", f"{skipped}[1].does[1:2]", "NULL::INT")})
 ELSE list_append(list_transform(st, lambda x: CASE WHEN NOT c.dry AND list_contains(list_transform({won}, lambda m: m.id), x.id) THEN {replaced} ELSE x END),
  {new.format(f"CASE WHEN len({even}) > 0 THEN 'contested' ELSE 'stored' END", "CASE WHEN NOT c.dry THEN 'live' END", f"{even}[-1].id", "NULL::VARCHAR", f"len({won})::INT")}) END FROM ({step})),
 z AS (SELECT claim_key, unnest(st) AS x FROM (SELECT claim_key, arg_max(st, k) AS st FROM r GROUP BY claim_key)) {tail}"""


_FILED = f"""SELECT claim_id, claim_key, lower(object) AS object, polarity, single, valid_from, valid_to, tier, confidence, (claim_id % 3)::INT AS sensitivity, [(claim_id // 4)::VARCHAR] AS provenance, [(claim_id // 16 % 5)::VARCHAR] AS roots, claim_id % 23 = 0 AS dry FROM ({_CLAIMS})"""


def _filed(t):
    k = F.col("claim_id")
    evidence = lambda n: F.array(n.cast("string"))
    return _claims(t).withColumns({"sensitivity": (k % 3).cast("int"), "provenance": evidence(F.floor(k / 4)), "roots": evidence(F.floor(k / 16) % 5), "dry": k % 23 == 0})


@query(fold_sql(_FILED, "SELECT x.id AS claim_id, x.outcome AS outcome, x.status AS status, x.met AS met, x.by AS \"by\", x.rule AS rule, x.valid_to AS ends, x.replaced AS replaced FROM z"))
def claim_fold(t):
    return fold.filed(_filed(t)).select("claim_id", "outcome", "status", "met", "by", "rule", F.col("valid_to").alias("ends"), "replaced")


@query(fold_sql(_FILED, "SELECT x.id AS claim_id, array_to_string(list_sort(x.provenance), ',') AS provenance, x.corroboration AS corroboration, x.confidence AS confidence, x.tier AS tier, x.sensitivity AS sensitivity FROM z WHERE x.status IS NOT NULL"))
def claim_corroborate(t):
    rows = fold.filed(_filed(t)).where("status IS NOT NULL")
    return rows.select("claim_id", F.array_join(F.array_sort("provenance"), ",").alias("provenance"), "corroboration", "confidence", "tier", "sensitivity")


_ALL = "SELECT * REPLACE (claim_key::VARCHAR AS claim_key) FROM ({0})"
_ASKED = """SELECT -o_orderkey AS ord, 10000000000 + o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'correct' ELSE 'propose' END AS intent, CASE WHEN o_orderkey % 4 = 0 THEN 'owner' WHEN o_orderkey % 4 = 1 THEN 'agent:x' ELSE 'connector' END AS producer,
 CASE WHEN o_orderkey % 44 <> 0 THEN CASE WHEN o_orderkey % 28 = 0 THEN -o_custkey ELSE o_custkey * 2 + o_orderkey % 2 END END AS claim_key, lower(CASE WHEN o_orderkey % 6 = 0 THEN 'F' ELSE o_orderstatus END) AS object, 'positive' AS polarity, o_orderkey % 2 = 0 AS single,
 CASE WHEN o_orderkey % 8 < 4 THEN TIMESTAMP '1997-01-01' ELSE o_orderdate END AS valid_from, NULL::TIMESTAMP AS valid_to, 0.4::DOUBLE AS confidence, o_orderkey % 9 = 0 AS unsure, o_custkey AS event, o_orderkey % 10 = 0 AS dry FROM orders WHERE o_orderkey % 3 = 0"""
_FIT = f"""(SELECT *, CASE WHEN unsure OR event % 5 = 0 THEN 'provenance' WHEN intent = 'correct' AND claim_key IS NULL THEN 'target_required' END AS early,
 min(request_id) OVER (PARTITION BY CASE WHEN dry THEN request_id ELSE 0 END, intent, producer, claim_key, object, polarity, valid_from, valid_to) AS first FROM ({_ASKED}))"""
_STANDING = fold_sql(f"SELECT * FROM ({_FILED}) WHERE claim_id % 3 > 0 AND claim_id % 23 > 0", "SELECT DISTINCT claim_key FROM z WHERE x.status = 'live'")
_TIER = "CASE WHEN intent = 'correct' THEN 4 WHEN producer = 'agent:x' THEN 1 ELSE 2 END"
_REQUESTS = f"""SELECT request_id AS claim_id, claim_key, object, polarity, single, valid_from, valid_to, {_TIER} AS tier, confidence, 0 AS sensitivity, [event::VARCHAR] AS provenance, [(event % 7)::VARCHAR] AS roots, dry FROM {_FIT}
 WHERE early IS NULL AND request_id = first AND NOT (intent = 'correct' AND claim_key NOT IN (SELECT claim_key FROM ({_STANDING}))) AND claim_key IS NOT NULL"""


@query(f"""SELECT request_id, CASE WHEN why IS NOT NULL THEN 'refused' WHEN request_id <> first THEN 'replayed' ELSE coalesce(outcome, 'stored') END AS outcome, why AS reason, met, CASE WHEN why IS NULL AND request_id = first AND claim_key IS NULL THEN 0 ELSE replaced END AS replaced
FROM (SELECT f.*, CASE WHEN early IS NOT NULL THEN early WHEN request_id = first AND intent = 'correct' AND claim_key NOT IN (SELECT claim_key FROM ({_STANDING})) THEN 'claim_unknown' END AS why, d.outcome, d.met, d.replaced FROM {_FIT} f
 LEFT JOIN ({fold_sql(f"SELECT * FROM ({_FILED}) WHERE claim_id % 3 > 0 AND claim_id % 23 > 0 UNION ALL BY NAME {_REQUESTS}", "SELECT x.id AS id, x.outcome AS outcome, x.met AS met, x.replaced AS replaced FROM z")}) d ON d.id = f.request_id)""")
def claim_requests(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    event = F.when(k % 9 != 0, F.array(c)).otherwise(F.array().cast("array<long>"))
    requests = t("orders").where(k % 3 == 0).select(
        (k + 10_000_000_000).alias("request_id"), F.when(k % 4 == 0, "correct").otherwise("propose").alias("intent"), F.when(k % 4 == 0, "owner").when(k % 4 == 1, "agent:x").otherwise("connector").alias("producer"),
        F.when(k % 44 != 0, F.when(k % 28 == 0, -c).otherwise(c * 2 + k % 2)).alias("claim_key"), F.when(k % 2 == 0, "project.status").otherwise("skill.practises").alias("predicate"), F.when(k % 6 == 0, "F").otherwise(F.col("o_orderstatus")).alias("object"),
        F.lit("positive").alias("polarity"), F.when(k % 8 < 4, F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).otherwise(F.col("o_orderdate")).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(0.4).alias("confidence"), event.alias("provenance"), (k % 10 == 0).alias("dry"),
    )
    id_ = F.col("c_custkey")
    events = t("customer").where(id_ % 5 != 0).select(id_.alias("event_id"), (id_ % 7).alias("root"), F.lit("quoted").alias("taint"), F.lit("c").alias("connector"))
    return fold.requested(requests, _filed(t).where("claim_id % 3 > 0 AND claim_id % 23 > 0"), events)


@query("SELECT event_id, user_id, props, row_number() OVER (ORDER BY ts, event_id) + 99 AS number FROM events")
def dense_numbers_carried(t):
    return L.numbered(t("events").select("ts", "event_id", "user_id", "props"), "ts", "event_id", start=100).select("event_id", "user_id", "props", "number")


@query("SELECT event_id, prior_id FROM (SELECT event_id, value, lag(event_id) OVER w AS prior_id, lag(value) OVER w AS pv FROM events WINDOW w AS (ORDER BY ts, event_id)) WHERE value < pv")
def monotone_log(t):
    """Steps back over the whole log, whoever wrote the entries."""
    rows = t("events").select("event_id", "ts", F.col("value"), F.struct("event_id", "value").alias("entry"))
    found = scan.prior(rows, "before", "entry", "ts", "event_id")
    return found.where(F.col("value") < F.col("before.value")).select("event_id", F.col("before.event_id").alias("prior_id"))


@query("SELECT o_custkey, o_orderkey, round((sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE, 2) AS spent, max(o_totalprice) OVER w AS most, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def running_spend(t):
    rows = scan.ranged(t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    found = scan.running(rows, ("o_custkey",), ("o_orderdate", "o_orderkey"), ("spent", "sum", price.cast("decimal(18,2)")), ("most", "max", price), ("n", "sum", F.lit(1).cast("long")))
    return found.select("o_custkey", "o_orderkey", F.round(F.col("spent").cast("double"), 2).alias("spent"), "most", "n")


@query("""WITH q AS (SELECT user_id, event_id AS ask, ts + INTERVAL 6 HOUR AS at FROM events WHERE event_type = 'view'), h AS (SELECT user_id, event_id, ts, event_type AS status, value, ts + INTERVAL 2 DAY AS valid_to FROM events WHERE event_type IN ('click', 'signup', 'purchase')),
 s AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), j AS (SELECT q.ask, h.*, row_number() OVER (PARTITION BY q.ask ORDER BY h.ts DESC, h.event_id DESC) AS n, count(*) OVER (PARTITION BY q.ask) AS n_known FROM q JOIN h ON h.user_id = q.user_id AND h.ts <= q.at)
SELECT q.ask, j.event_id AS known_id, j.status, CASE WHEN j.valid_to <= q.at THEN 'ended' WHEN j.event_id IS NOT NULL THEN 'holds' ELSE 'unknown' END AS state, coalesce(j.n_known, 0) AS n_known, coalesce((SELECT count(*) FROM s WHERE s.user_id = q.user_id AND s.ts <= q.at), 0) AS support FROM q LEFT JOIN j ON j.ask = q.ask AND j.n = 1""")
def known_at_each(t):
    e = t("events")
    history = e.where(F.col("event_type").isin("click", "signup", "purchase")).select("user_id", "event_id", F.col("ts").alias("at"), F.col("event_type").alias("status"), F.expr("ts + INTERVAL 2 DAY").alias("valid_to"))
    asked = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("ask"), F.expr("ts + INTERVAL 6 HOUR").alias("at"))
    support = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"))
    found = scan.as_of(asked, history, "user_id", "at", ("event_id", "status", "valid_to"), "event_id", support)
    state = F.when(F.col("state.valid_to") <= F.col("at"), "ended").when(F.col("state").isNotNull(), "holds").otherwise("unknown")
    return found.select("ask", F.col("state.event_id").alias("known_id"), F.col("state.status").alias("status"), state.alias("state"), "n_known", F.coalesce("n_counted", F.lit(0)).alias("support"))
