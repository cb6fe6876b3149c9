"""Queries over ledger reads, scopes, the belief graph's states, lineage, and the later steps of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import claims as C
from siltstone.operators import graph as G
from siltstone.operators import ledger as L
from siltstone.operators import policy as P
from siltstone.operators import reports as R
from siltstone.operators import search as Q
from siltstone.operators import world as W
from siltstone.plans.catalog import _EDGES, _LEDGER, _LIVE, _WORDS, _edges, _ledger, _similar
from siltstone.plans.registry import query


def _at(text: str):
    return F.to_timestamp_ntz(F.lit(text))


# --- ledger reads ---


@query(f"{_LIVE} SELECT event_id FROM live WHERE kind IN ('click', 'view') AND accepted_at >= TIMESTAMP '2024-01-10'")
def ledger_replay(t):
    return L.replay(_ledger(t), "record", kinds=("click", "view"), since="2024-01-10 00:00:00", only_live=True).select("event_id")


@query("SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id > 5)) AS n, count(*) AS total, max(ts) AS accepted_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events")
def ledger_count_since(t):
    return L.count_since(_ledger(t), _at("2024-01-20 00:00:00"), 5)


@query(f"{_LIVE} SELECT event_id, event_id IN (SELECT event_id FROM live) AS alive FROM l WHERE event_id % 97 = 0")
def ledger_lookup(t):
    ids = t("events").where("event_id % 97 = 0").select("event_id")
    return L.lookup(_ledger(t), ids, "record").select("event_id", "alive")


@query(f"""WITH l AS ({_LEDGER}), h AS (SELECT DISTINCT record, kind, props FROM l WHERE event_id % 2 = 1), b AS (SELECT *, value > 50 AS ok, row_number() OVER (PARTITION BY record, kind, props, value > 50 ORDER BY accepted_at, event_id) AS n FROM l WHERE event_id % 2 = 0)
SELECT event_id, CASE WHEN NOT ok THEN 'error' WHEN record % 10 = 0 THEN 'suppressed' WHEN n > 1 OR EXISTS (SELECT 1 FROM h WHERE h.record = b.record AND h.kind = b.kind AND h.props = b.props) THEN 'duplicate' ELSE 'stored' END AS outcome FROM b""")
def ledger_accept_outcomes(t):
    rows = _ledger(t)
    gone = rows.where("record % 10 = 0").select("record").distinct()
    return L.accepted(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), gone, F.col("value") > 50, "record", "kind", "props").select("event_id", "outcome")


@query(f"WITH l AS ({_LEDGER}), m AS (SELECT *, row_number() OVER (PARTITION BY record, value > 250 ORDER BY accepted_at DESC, event_id DESC) AS n FROM l) SELECT record, value > 250 AS high, event_id FROM m WHERE n = 1 AND NOT deleted")
def ledger_mirror(t):
    return L.mirrored(_ledger(t).withColumn("high", F.col("value") > 250), "record", "high").select("record", "high", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS title FROM documents UNION ALL SELECT -doc_id, 2, source FROM documents WHERE doc_id % 50 = 1")
def doc_upsert(t):
    index = t("documents").select("doc_id", F.lit(1).alias("version"), F.col("source").alias("title"))
    batch = t("documents").where("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("version"), F.upper("source").alias("title"))
    new = t("documents").where("doc_id % 50 = 1").select((-F.col("doc_id")).alias("doc_id"), F.lit(2).alias("version"), F.col("source").alias("title"))
    return L.upserted(index, batch.unionByName(new), "doc_id", "version")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 99 AS number FROM events")
def dense_numbers(t):
    return L.numbered(t("events").select("ts", "event_id"), "ts", "event_id", start=100).select("event_id", "number")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_keeper(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return C.kept_first(t("events"), ["user_id"], rank, "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, count(*) AS n, sum(length(o_orderpriority))::BIGINT AS bytes, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 2 AND 12 AND sum(length(o_orderpriority)) <= 90")
def claim_read_groups(t):
    return R.read_groups(t("orders").withColumn("size", F.length("o_orderpriority")), "o_custkey", "size", "o_orderdate", 12, 90)


@query("""WITH h AS (SELECT user_id AS record, event_id AS sequence, ts AS recorded_at, event_type AS status FROM events), s AS (SELECT record, CASE WHEN record % 10 = 0 THEN 'view' ELSE arg_max(status, sequence) END AS status FROM h WHERE record <> 7 GROUP BY record UNION ALL SELECT -1, 'click'),
 p AS (SELECT *, lag(recorded_at) OVER (ORDER BY sequence) AS prior FROM h), z AS (SELECT record, arg_max(status, sequence) AS last FROM h GROUP BY record)
SELECT 'clock_back' AS rule, count(*) AS n FROM p WHERE recorded_at < prior UNION ALL SELECT 'state_differs', count(*) FROM s JOIN z USING (record) WHERE status IS DISTINCT FROM last
UNION ALL SELECT 'orphan_entry', count(*) FROM h WHERE record NOT IN (SELECT record FROM s) UNION ALL SELECT 'no_history', count(*) FROM s WHERE record NOT IN (SELECT record FROM h)""")
def history_integrity(t):
    h = t("events").select(F.col("user_id").alias("record"), F.col("event_id").alias("sequence"), F.col("ts").alias("recorded_at"), F.col("event_type").alias("status"))
    last = h.where("record <> 7").groupBy("record").agg(F.max_by("status", "sequence").alias("status"))
    states = last.withColumn("status", F.when(F.col("record") % 10 == 0, "view").otherwise(F.col("status"))).unionByName(t("events").limit(1).select(F.lit(-1).cast("long").alias("record"), F.lit("click").alias("status")))
    return L.integrity(h, states)


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 200")
def page_offset(t):
    return t("events").orderBy("ts", "event_id").offset(200).limit(50).select("event_id")


@query("""WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS all_rows FROM events WHERE user_id IN (3, 5))
SELECT user_id, event_id, all_rows > 20 AS more FROM p WHERE user_id = 3 AND n <= 20 UNION ALL SELECT user_id, event_id, all_rows > 1000000 FROM p WHERE user_id = 5 AND n <= 1000000""")
def page_sentinel(t):
    """Pages of two lists, and whether a row behind them was found: there is one behind the first."""

    def page(user, size):
        rows = t("events").where(F.col("user_id") == user).orderBy("ts", "event_id").limit(size + 1)
        more = rows.agg((F.count(F.lit(1)) > size).alias("more"))
        return rows.orderBy("ts", "event_id").limit(size).crossJoin(F.broadcast(more)).select("user_id", "event_id", "more")

    return page(3, 20).unionByName(page(5, 1_000_000))


# --- scopes and policy ---


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND (user_id IN (3, 5) OR user_id % 10 IN (3, 5))")
def any_of_scope(t):
    subjects = F.array(F.col("user_id"), F.col("user_id") % 10)
    return t("events").where(P.in_scope(F.col("event_type"), P.any_of("click", ("view", "click"))) & P.in_scope(subjects, (3, 5), array=True)).select("event_id")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'signup' THEN 0 ELSE 2 END AS default_rank, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'signup' THEN 0 ELSE 2 END AS floor_rank, count(*) AS n FROM events GROUP BY event_type")
def source_class_policy(t):
    kind = F.when(F.col("event_type") == "click", "email").when(F.col("event_type") == "view", "saved_web").when(F.col("event_type") == "signup", "public_posts")
    p = P.source_policy(kind)
    return t("events").groupBy("event_type", p["default"].alias("default_rank"), p["floor"].alias("floor_rank")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN 'service' ELSE role END AS kind, CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN '... !' WHEN 2 THEN substr(text, 1, 8) ELSE '  ' END AS text FROM conversations),
 n AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]')) + 3 * len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS k FROM c)
SELECT coalesce(CASE WHEN kind = 'service' THEN 'service' WHEN trim(text) = '' THEN 'empty' WHEN k = 0 THEN 'no_words' WHEN k < 12 THEN 'too_short' END, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1""")
def extract_prefilter(t):
    c = F.col("conv_id") % 4
    text = F.when(c == 0, F.col("text")).when(c == 1, "... !").when(c == 2, F.substring("text", 1, 8)).otherwise("  ")
    kind = F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 == 0), "service").otherwise(F.col("role"))
    return t("conversations").groupBy(F.coalesce(P.prefilter_reason(kind, text), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(url, '^(.*/)?en/[^/]*$') THEN 'english' END, CASE WHEN regexp_matches(url, '^http[^/]*://m\..*$') THEN 'mobile' END, CASE WHEN regexp_matches(url, '^.*page=[^/]$') THEN 'paged' END], lambda x: x IS NOT NULL)), ',') AS classes FROM pages""")
def path_globs(t):
    return t("pages").select("page_id", F.array_join(P.path_classes(F.array("url"), {"**/en/*": "english", "http*://m.**": "mobile", "**page=?": "paged"}), ",").alias("classes"))


@query("SELECT o_orderkey AS claim_id FROM orders WHERE o_custkey % 7 IN (1, 2) AND o_orderkey % 3 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def evidence_selection(t):
    claims = t("orders").select(F.col("o_orderkey").alias("claim_id"), F.array(F.col("o_custkey") % 7, F.lit(99).cast("long")).alias("subjects"), F.col("o_orderpriority").alias("source"))
    sources = t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderpriority").alias("source")).distinct()
    return P.selected(claims, t("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("claim_id")), (1, 2), sources).select("claim_id")


_SPAN = "SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS valid_from, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL 90 DAY END AS valid_to FROM orders"


def _spans(t):
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("claim_id"), F.when(k % 9 > 0, F.col("o_orderdate")).alias("valid_from"), F.when(k % 5 > 0, F.expr("o_orderdate + INTERVAL 90 DAY")).alias("valid_to"))


@query(f"WITH c AS ({_SPAN}) SELECT claim_id, 'span' AS how FROM c WHERE valid_from < TIMESTAMP '1998-07-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-01') UNION ALL SELECT claim_id, 'unknown' FROM c WHERE valid_from IS NULL")
def valid_time_modes(t):
    rows = _spans(t)
    span = W.valid_at(rows, "1998-06-01 00:00:00", "1998-07-01 00:00:00").select("claim_id", F.lit("span").alias("how"))
    return span.unionByName(W.valid_at(rows, unknown=True).select("claim_id", F.lit("unknown").alias("how")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 3 > 0 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01'")
def claim_type_policy(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 3 > 0).alias("typed"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("asserted_at"))
    return W.typed(rows, ("1-URGENT", "5-LOW"), "1997-01-01 00:00:00", "1998-01-01 00:00:00").select("o_orderkey")


@query("""WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 4 WHEN o_orderkey % 4 = 2 THEN 3 WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS base FROM orders),
 s AS (SELECT *, base < 3 AND k % 5 = 0 AND k % 13 <> 0 AND k % 6 <> 1 AS single FROM b)
SELECT k AS o_orderkey, CASE WHEN single THEN 1 ELSE base END AS tier, CASE WHEN single THEN 0.5 ELSE 1 END::DOUBLE AS cap FROM s""")
def claim_authority(t):
    k = F.col("o_orderkey")
    producer = F.when(k % 4 == 0, "connector").when(k % 4 == 1, "model").when(k % 4 == 2, "owner").otherwise("agent:x")
    taints = F.when(k % 5 == 0, F.array(F.lit("untrusted"))).otherwise(F.array(F.lit("owner"), F.lit("quoted")))
    a = C.authority(F.when(k % 3 == 0, "correct").otherwise("propose"), producer, k % 7 == 0, taints, F.when(k % 6 == 1, F.array(F.lit("c"), F.lit("d"))).otherwise(F.array(F.lit("c"), F.lit("c"))), k % 13 == 0)
    return t("orders").select("o_orderkey", a["tier"].alias("tier"), a["cap"].alias("cap"))


# --- states of the belief graph ---

_DUE = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'soon' END"""


@query(f"""WITH d AS (SELECT o_orderkey, {_DUE} AS due FROM orders), i AS (SELECT *, CASE WHEN length(due) = 10 THEN (due || ' 23:59:59.999')::TIMESTAMP WHEN due <> 'soon' THEN replace(due, 'T', ' ')::TIMESTAMP END AS at FROM d)
SELECT o_orderkey, at AS deadline, CASE WHEN at IS NULL THEN 'unknown' WHEN CASE WHEN length(due) = 10 THEN '1998-06-01' > due ELSE TIMESTAMP '1998-06-01 08:00:00' > at END THEN 'yes' ELSE 'no' END AS overdue FROM i""".replace(" at AS", " seen AS").replace(" AS at FROM", " AS seen FROM").replace("WHEN at IS", "WHEN seen IS").replace("> at END", "> seen END"))
def commitment_overdue(t):
    k = F.col("o_orderkey") % 4
    due = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, "soon")
    return t("orders").select("o_orderkey", W.deadline(due).alias("deadline"), W.overdue(F.array(due, due), _at("1998-06-01 08:00:00")).alias("overdue"))


_SAID = "SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'dropped' END AS status, o_orderkey % 7 = 0 AS owner, o_orderkey % 5 > 0 AS asserted FROM orders"


@query(f"""WITH s AS ({_SAID}), g AS (SELECT o_custkey, bool_or(status = 'open' AND asserted AND owner) AS oo, bool_or(status = 'dropped' AND asserted AND owner) AS od, bool_or(status = 'done' AND asserted AND owner) AS odone, bool_or(status = 'open' AND asserted) AS o, bool_or(status = 'dropped' AND asserted) AS dr,
 bool_or(status = 'done') AS done, count(DISTINCT status) FILTER (asserted OR status = 'done') AS n FROM s GROUP BY 1)
SELECT o_custkey, CASE WHEN oo THEN 'open' WHEN od THEN 'dropped' WHEN odone AND NOT dr AND NOT o THEN 'done' WHEN n = 1 AND dr THEN 'dropped' WHEN done THEN 'claimed_done' ELSE 'open' END AS status, n > 1 AS uncertain FROM g""")
def commitment_status(t):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = t("orders").select("o_custkey", F.when(s == "O", "open").when(s == "F", "done").otherwise("dropped").alias("status"), (k % 7 == 0).alias("owner"), (k % 5 > 0).alias("asserted"))
    return W.commitment_status(rows, "o_custkey")


_ASKED = """SELECT o_custkey AS question, CASE WHEN o_orderkey % 2 = 0 THEN 'status' ELSE 'answer' END AS kind, CASE o_orderkey % 10 WHEN 0 THEN 'abandoned' WHEN 2 THEN 'reopened' WHEN 4 THEN 'resolved' WHEN 6 THEN 'partial' ELSE 'open' END AS value,
 o_orderkey % 9 = 0 AS owner, o_orderkey % 3 AS roots, CASE WHEN o_orderkey % 7 = 0 THEN 'present' ELSE 'none_observed' END AS conflict FROM orders"""
_QUESTION = f"""WITH s AS ({_ASKED}), g AS (SELECT question, bool_or(kind = 'status' AND owner AND value = 'abandoned') AS ab, bool_or(kind = 'status' AND owner AND value = 'reopened') AS re, bool_or(kind = 'status' AND owner AND value = 'resolved') AS so, bool_or(kind = 'status' AND owner AND value = 'partial') AS pa,
 bool_or(kind = 'status' AND owner AND value = 'open') AS op, bool_or(kind = 'answer' AND conflict = 'present') AS opposed, bool_or(kind = 'answer' AND (owner OR roots >= 2) AND conflict = 'present') AS gop, bool_or(kind = 'answer' AND (owner OR roots >= 2) AND conflict = 'none_observed') AS backed FROM s GROUP BY 1),
 q AS (SELECT question, CASE WHEN ab THEN 'abandoned' WHEN re OR (so AND opposed) OR gop THEN 'reopened' WHEN so THEN 'resolved' WHEN pa THEN 'partial' WHEN NOT op AND backed THEN 'resolved' ELSE 'open' END AS status FROM g)"""


def _questions(t):
    k = F.col("o_orderkey")
    value = F.when(k % 10 == 0, "abandoned").when(k % 10 == 2, "reopened").when(k % 10 == 4, "resolved").when(k % 10 == 6, "partial").otherwise("open")
    rows = t("orders").select(F.col("o_custkey").alias("question"), F.when(k % 2 == 0, "status").otherwise("answer").alias("kind"), value.alias("value"), (k % 9 == 0).alias("owner"), (k % 3).alias("roots"), F.when(k % 7 == 0, "present").otherwise("none_observed").alias("conflict"))
    return W.question_status(rows, "question")


@query(f"{_QUESTION} SELECT * FROM q")
def question_lifecycle(t):
    return _questions(t)


@query(f"""{_QUESTION}, f AS (SELECT question, CASE WHEN status IN ('open', 'partial') THEN 'unresolved_question' WHEN status = 'reopened' THEN 'contradiction' END AS gap FROM q UNION SELECT question, 'coverage' FROM q WHERE question % 6 = 0)
SELECT gap, count(*) AS n, min(question) AS first FROM f WHERE gap IS NOT NULL GROUP BY gap""")
def question_frontier(t):
    gaps = F.when(F.col("question") % 6 == 0, F.array(F.lit("coverage"), F.lit("coverage"))).otherwise(F.array().cast("array<string>"))
    return W.frontier(_questions(t).withColumn("gaps", gaps), "question").groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.min("question").alias("first"))


@query("SELECT l_suppkey, CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'self_report' WHEN l_returnflag = 'A' THEN 'observed_outcome' WHEN l_returnflag = 'N' THEN 'exposure' ELSE 'application' END AS class, count(*) AS n FROM lineitem GROUP BY ALL")
def skill_split(t):
    flag = F.col("l_returnflag")
    rows = t("lineitem").select("l_suppkey", F.when(flag == "A", "observed_outcome").when(flag == "N", "exposure").otherwise("application").alias("evidence"), (F.col("l_linenumber") % 2 == 1).alias("independent"))
    return W.skill_evidence(rows).groupBy("l_suppkey", "class").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, coalesce(holder, -1) AS holder, coalesce(speaker, -1) AS speaker, event_type AS mode, count(*) AS n, array_to_string(list_sort(list_distinct(list(predicate))), ',') AS predicates FROM (SELECT user_id, event_type, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS holder, CASE WHEN event_id % 2 > 0 THEN 1 END AS speaker,
 ['world.kind', 'person.role', 'relationship.with'][1 + event_id % 3] AS predicate FROM events) WHERE predicate <> 'world.kind' GROUP BY user_id, 2, 3, event_type""")
def person_perspectives(t):
    e = F.col("event_id")
    predicate = F.element_at(F.array(F.lit("world.kind"), F.lit("person.role"), F.lit("relationship.with")), (1 + e % 3).cast("int"))
    rows = t("events").select("user_id", F.when(e % 3 > 0, e % 3).alias("holder"), F.when(e % 2 > 0, 1).alias("speaker"), F.col("event_type").alias("mode"), predicate.alias("predicate"))
    return W.perspectives(rows, "user_id").withColumns({"predicates": F.array_join("predicates", ","), "holder": F.coalesce("holder", F.lit(-1)), "speaker": F.coalesce("speaker", F.lit(-1))})


@query("""WITH f AS (SELECT event_id AS facet_id, user_id AS actor, event_id % 20 AS task, ts AS a, ts + INTERVAL 10 DAY AS b FROM events WHERE event_type = 'signup'), e AS (SELECT user_id AS actor, event_id % 20 AS task, CASE WHEN event_id % 3 = 0 THEN 'assisted' ELSE 'unassisted' END AS v, value > 60 AS sure, ts AS a, CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 5 DAY END AS b FROM events WHERE event_type = 'click')
SELECT facet_id, CASE WHEN coalesce(bool_and(sure), false) AND count(DISTINCT v) = 1 THEN min(v) ELSE 'unknown' END AS assistance FROM f LEFT JOIN e ON f.actor = e.actor AND f.task = e.task AND NOT coalesce(e.b <= f.a OR f.b <= e.a, false) GROUP BY facet_id""")
def learning_assistance(t):
    e = t("events").withColumns({"actor": F.col("user_id"), "task": F.col("event_id") % 20, "valid_from": F.col("ts")})
    facets = e.where("event_type = 'signup'").select(F.col("event_id").alias("facet_id"), "actor", "task", "valid_from", F.expr("ts + INTERVAL 10 DAY AS valid_to"))
    ends = F.when(F.col("event_id") % 4 > 0, F.expr("ts + INTERVAL 5 DAY"))
    evidence = e.where("event_type = 'click'").select("actor", "task", F.when(F.col("event_id") % 3 == 0, "assisted").otherwise("unassisted").alias("value"), (F.col("value") > 60).alias("sure"), "valid_from", ends.alias("valid_to"))
    return W.assistance(facets, evidence)


_STAGE = """SELECT event_id // 12 AS task, user_id % 2 AS environment, CASE WHEN event_id % 3 = 0 THEN 'reported' WHEN event_id % 3 = 1 THEN 'observed' ELSE 'reviewed' END AS stage, CASE WHEN event_id % 3 = 1 THEN CASE WHEN value > 20 THEN 'met' ELSE 'not_met' END WHEN value > 20 THEN 'accepted' ELSE 'rejected' END AS result,
 user_id AS root, ts AS seen, value > 400 AS confounded FROM events"""


@query(f"""WITH e AS ({_STAGE}), r AS (SELECT task, environment, list(DISTINCT root) AS roots, bool_or(confounded) AS blurred FROM e WHERE stage = 'reported' GROUP BY ALL),
 o AS (SELECT e.*, r.roots FROM e JOIN r USING (task, environment) WHERE stage <> 'reported' AND NOT list_contains(roots, root)),
 s AS (SELECT task, environment, arg_max(result, (seen, root)) FILTER (stage = 'observed') AS ob, arg_max(result, (seen, root)) FILTER (stage = 'reviewed') AS re, bool_or(result IN ('not_met', 'rejected')) AS neg, bool_or(confounded) AS blur2 FROM o GROUP BY ALL)
SELECT task, environment, CASE WHEN NOT blurred AND NOT coalesce(blur2, false) AND re = 'accepted' AND ob = 'met' AND NOT neg THEN 'met' WHEN NOT blurred AND NOT coalesce(blur2, false) AND ob = 'not_met' AND re = 'rejected' THEN 'not_met' ELSE 'unknown' END AS result FROM r LEFT JOIN s USING (task, environment)""")
def outcome_evaluation(t):
    e = F.col("event_id")
    stage = F.when(e % 3 == 0, "reported").when(e % 3 == 1, "observed").otherwise("reviewed")
    good = F.col("value") > 20
    result = F.when(e % 3 == 1, F.when(good, "met").otherwise("not_met")).otherwise(F.when(good, "accepted").otherwise("rejected"))
    rows = t("events").select(F.floor(e / 12).alias("task"), (F.col("user_id") % 2).alias("environment"), stage.alias("stage"), result.alias("result"), F.col("user_id").alias("root"), F.col("ts").alias("at"), (F.col("value") > 400).alias("confounded"))
    return W.outcomes(rows, "task", "environment")


_DUES = "SELECT o_orderkey // 2 AS item, CASE WHEN o_orderkey % 17 > 0 THEN date_trunc('year', o_orderdate) END AS due, o_orderkey % 23 = 0 AS settled FROM orders"
_BASIS = f"""WITH own AS (SELECT item, count(DISTINCT due) AS n, min(due) AS due, bool_or(settled) AS settled, bool_or(due IS NULL) AS open FROM ({_DUES}) GROUP BY item), sure AS (SELECT * FROM own WHERE n = 1 AND NOT open),
 need AS (SELECT p.item, max(s.due) AS latest, bool_or(s.due IS NULL) AS vague FROM (SELECT l_orderkey // 2 AS item, min(l_partkey) AS needs FROM lineitem GROUP BY 1) p LEFT JOIN sure s ON s.item = p.needs GROUP BY 1),
 f AS (SELECT sure.item, sure.due, CASE WHEN latest > sure.due THEN 0.25 ELSE 0.5 END::DOUBLE AS probability FROM sure LEFT JOIN need USING (item) WHERE NOT settled AND NOT coalesce(vague, false))"""


def _forecasts(t):
    k = F.col("o_orderkey")
    dues = t("orders").select(F.floor(k / 2).alias("item"), F.when(k % 17 > 0, F.date_trunc("year", "o_orderdate").cast("timestamp_ntz")).alias("due"), (k % 23 == 0).alias("settled"))
    needs = t("lineitem").groupBy(F.floor(F.col("l_orderkey") / 2).alias("item")).agg(F.min("l_partkey").alias("needs"))
    return W.forecasts(dues, needs)


@query(f"{_BASIS} SELECT * FROM f")
def forecast_basis(t):
    return _forecasts(t)


@query(f"""{_BASIS}, e AS (SELECT o_orderkey // 2 AS item, o_orderdate AS seen, o_orderdate - INTERVAL 30 DAY AS done_at, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'dropped' WHEN 2 THEN 'met' ELSE 'not_met' END AS what FROM orders),
 r AS (SELECT f.item, e.seen, CASE WHEN what = 'dropped' THEN 'censored' WHEN what = 'done' AND done_at <= seen THEN CASE WHEN done_at <= due THEN 'resolved_met' ELSE 'resolved_not_met' END WHEN what = 'met' AND seen <= due THEN 'resolved_met' END AS said FROM f LEFT JOIN e ON e.item = f.item AND e.seen >= f.due - INTERVAL 400 DAY)
SELECT item AS forecast_id, coalesce(arg_min(said, (seen, said)) FILTER (said IS NOT NULL), 'open') AS status, min(seen) FILTER (said IS NOT NULL) AS resolved_at FROM r GROUP BY item""")
def forecast_resolution(t):
    k = F.col("o_orderkey")
    made = _forecasts(t).select(F.col("item").alias("forecast_id"), "item", "due", F.expr("due - INTERVAL 400 DAY AS frozen_at"))
    what = F.when(k % 4 == 0, "done").when(k % 4 == 1, "dropped").when(k % 4 == 2, "met").otherwise("not_met")
    evidence = t("orders").select(F.floor(k / 2).alias("item"), F.col("o_orderdate").alias("at"), F.expr("o_orderdate - INTERVAL 30 DAY AS done_at"), what.alias("what"))
    return W.forecast_resolution(made, evidence)


@query("""SELECT o_orderkey, cue FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'blocker' WHEN '2-HIGH' THEN 'due' WHEN '3-MEDIUM' THEN 'uncertainty' ELSE 'stale' END AS cue, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS r FROM orders
 WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 900 DAY > TIMESTAMP '1999-06-01')) ORDER BY r, o_orderkey LIMIT 16""")
def attention_snooze(t):
    p = F.col("o_orderpriority")
    cue = F.when(p == "1-URGENT", "blocker").when(p == "2-HIGH", "due").when(p == "3-MEDIUM", "uncertainty").otherwise("stale")
    cues = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", cue.alias("cue"))
    snoozed = t("orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.expr("o_orderdate + INTERVAL 900 DAY AS until"))
    return W.attention(cues, snoozed, _at("1999-06-01 00:00:00"), "o_orderkey").select("o_orderkey", "cue")


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) >= 1000000::BIGINT * CASE event_type WHEN 'view' THEN 900 WHEN 'click' THEN 86400 WHEN 'signup' THEN 604800 ELSE 900 END")
def view_expiry(t):
    k = F.col("event_type")
    kinds = F.when(k == "view", "view").when(k == "click", "resume").when(k == "signup", "consolidation").otherwise("packet")
    return W.expired(t("events").withColumn("kind", kinds), "ts", _at("2024-01-20 00:00:00")).select("event_id")


@query("SELECT l_orderkey, arg_min(l_partkey, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, -(l_linenumber % 4 + 1), l_shipdate, l_partkey)) AS page_id FROM lineitem GROUP BY l_orderkey")
def page_arbiter(t):
    flag = F.col("l_returnflag")
    rows = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("page_id"), F.when(flag == "A", "bound").when(flag == "N", "explicit").otherwise("subject").alias("via"), (F.col("l_linenumber") % 4 + 1).alias("tier"), F.col("l_shipdate").alias("created_at"))
    return W.chosen_page(rows, "l_orderkey")


# --- graph ---


@query(r"""SELECT DISTINCT page_id::VARCHAR AS src, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS dst, 'wikilink' AS kind FROM pages UNION SELECT page_id::VARCHAR, split_part(url, '/', 3), 'subject' FROM pages UNION SELECT page_id::VARCHAR, url, 'source' FROM pages""")
def graph_edge_kinds(t):
    p = t("pages").withColumn("page_id", F.col("page_id").cast("string"))
    links = p.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1))).alias("dst"))
    return G.projected(p.select("page_id", F.array(F.split_part("url", F.lit("/"), F.lit(3))).alias("subjects"), F.array("url").alias("sources")), links)


@query(f"WITH e AS ({_EDGES}), n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey % 4 END AS s FROM supplier UNION ALL SELECT -1 - p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 END FROM part) SELECT src, count(*) AS n FROM e WHERE src IN (SELECT node FROM n WHERE s <= 1) AND dst IN (SELECT node FROM n WHERE s <= 1) GROUP BY src")
def graph_visible(t):
    label = lambda c: F.when(F.col(c) % 4 < 3, F.col(c) % 4).alias("sensitivity")
    nodes = t("supplier").select(F.col("s_suppkey").alias("node"), label("s_suppkey")).unionByName(t("part").select((-1 - F.col("p_partkey")).alias("node"), label("p_partkey")))
    return G.visible(_edges(t), nodes, 1).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT src FROM e WHERE (-1 - dst) % 40 = 3")
def graph_affected(t):
    return G.affected(_edges(t), t("part").where("p_partkey % 40 = 3").select((-1 - F.col("p_partkey")).alias("dst")))


@query(f"""WITH e AS ({_EDGES}), b AS (SELECT src AS node, dst AS next FROM e UNION ALL SELECT dst, src FROM e), h AS (SELECT 7 AS node UNION SELECT next FROM b WHERE node = 7), m AS (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT node FROM h) OR dst IN (SELECT node FROM h)), n AS (SELECT count(*) AS n FROM m)
(SELECT 100 AS most, src, dst, n > 100 AS truncated FROM m, n ORDER BY src, dst LIMIT 100) UNION ALL (SELECT 10000000, src, dst, n > 10000000 FROM m, n)""")
def graph_walk_edges(t):
    """The same walk within a bound that it fills and one that it doesn't."""
    start = t("supplier").where("s_suppkey = 7").select(F.col("s_suppkey").alias("node"))
    walk = lambda most: G.walked_edges(_edges(t), start, 2, most).select(F.lit(most).alias("most"), "src", "dst", "truncated")
    return walk(100).unionByName(walk(10_000_000))


_RING = """SELECT p_partkey AS src, p_partkey // 10 * 10 + (p_partkey % 10 * 3 + 1) % 10 AS dst, make_timestamp(2024, 1, 1 + (p_partkey % 7)::INT, 0, 0, 0) AS f, CASE WHEN p_partkey % 3 > 0 THEN make_timestamp(2024, 1, 4 + (p_partkey % 9)::INT, 0, 0, 0) ELSE TIMESTAMP '9999-12-31' END AS t FROM part"""


@query(f"""WITH RECURSIVE e AS ({_RING}), p(start, node, f, t, n) AS (SELECT src, dst, f, t, 1 FROM e UNION SELECT p.start, e.dst, greatest(p.f, e.f), least(p.t, e.t), n + 1 FROM p JOIN e ON p.node = e.src WHERE p.start <> p.node AND n < 6 AND greatest(p.f, e.f) < least(p.t, e.t)) SELECT DISTINCT start AS node FROM p WHERE start = node""")
def temporal_cycles(t):
    k = F.col("p_partkey")
    day = lambda d: F.make_timestamp_ntz(F.lit(2024), F.lit(1), d.cast("int"), F.lit(0), F.lit(0), F.lit(0))
    edges = t("part").select(k.alias("src"), (F.floor(k / 10) * 10 + (k % 10 * 3 + 1) % 10).alias("dst"), day(1 + k % 7).alias("valid_from"), F.when(k % 3 > 0, day(4 + k % 9)).alias("valid_to"))
    return G.cycles(edges, 6)


_SAME = "SELECT c_custkey // 4 * 4 AS a, c_custkey AS b, c_custkey % 13 > 0 AS same, c_custkey % 3 = 0 AS owner, c_nationkey AS root FROM customer UNION ALL SELECT c_custkey, c_custkey // 2 * 2, c_custkey % 17 > 0, false, c_nationkey + 100 FROM customer UNION ALL SELECT c_custkey, c_custkey // 4 * 4, true, false, 1000 FROM customer WHERE c_custkey % 5 > 0"


@query(f"""WITH RECURSIVE p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, bool_or(NOT same) AS denied, bool_or(same AND owner) OR count(DISTINCT root) FILTER (same) >= 2 AS fit FROM ({_SAME}) WHERE a <> b GROUP BY ALL), n AS (SELECT a AS x FROM p UNION SELECT b FROM p),
 g AS (SELECT a AS x, b AS y FROM p WHERE fit AND NOT denied UNION SELECT b, a FROM p WHERE fit AND NOT denied), r(node, seen) AS (SELECT x, x FROM n UNION SELECT g.y, r.seen FROM r JOIN g ON g.x = r.node), l AS (SELECT node, min(seen) AS c FROM r GROUP BY node),
 d AS (SELECT p.*, u.c AS ca, v.c AS cb FROM p JOIN l u ON u.node = a JOIN l v ON v.node = b WHERE denied OR NOT fit), sp AS (SELECT DISTINCT ca AS c FROM d WHERE denied AND ca = cb), be AS (SELECT ca AS c FROM d UNION SELECT cb FROM d), z AS (SELECT c, count(*) AS n FROM l GROUP BY c)
SELECT node, CASE WHEN c IN (SELECT c FROM sp) THEN node ELSE c END AS cluster, CASE WHEN c IN (SELECT c FROM sp) OR c IN (SELECT c FROM be) THEN 'ambiguous' WHEN n > 1 THEN 'resolved' ELSE 'distinct' END AS resolution FROM l JOIN z USING (c)""")
def identity_clusters(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    c = t("customer")
    row = lambda a, b, same, owner, root: c.select(a.alias("a"), b.alias("b"), same.alias("same"), owner.alias("owner"), root.alias("root"))
    one = row(F.floor(k / 4) * 4, k, k % 13 > 0, k % 3 == 0, n).unionByName(row(k, F.floor(k / 2) * 2, k % 17 > 0, F.lit(False), n + 100))
    return G.identities(one.unionByName(row(k, F.floor(k / 4) * 4, F.lit(True), F.lit(False), F.lit(1000).cast("long")).where("a % 5 > 0")))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS support, l_orderkey AS claim, CASE WHEN l_linenumber % 5 = 0 THEN 'dependent' WHEN l_partkey % 40 = 0 THEN 'unknown' ELSE 'independent' END AS derived, l_suppkey % 9 AS p1, 100 + l_partkey % 7 AS p2 FROM lineitem),
 i AS (SELECT * FROM s WHERE derived = 'independent'), q AS (SELECT claim, support, p1 AS p FROM i UNION ALL SELECT claim, support, p2 FROM i), g AS (SELECT DISTINCT a.support AS x, b.support AS y FROM q a JOIN q b ON a.claim = b.claim AND a.p = b.p), r(node, seen) AS (SELECT DISTINCT support, support FROM i UNION SELECT g.y, r.seen FROM r JOIN g ON g.x = r.node),
 l AS (SELECT node, min(seen) AS c FROM r GROUP BY node), n AS (SELECT claim, count(DISTINCT c) AS n FROM i JOIN l ON node = support GROUP BY claim)
SELECT claim, coalesce(any_value(n.n), 0) AS n_roots, CASE WHEN bool_or(derived = 'unknown') THEN 'unknown' ELSE 'known' END AS status FROM s LEFT JOIN n USING (claim) GROUP BY claim""")
def support_lineage(t):
    s = t("lineitem").select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("support"), F.col("l_orderkey").alias("claim"), F.when(F.col("l_linenumber") % 5 == 0, "dependent").when(F.col("l_partkey") % 40 == 0, "unknown").otherwise("independent").alias("derived"), (F.col("l_suppkey") % 9).alias("p1"), (100 + F.col("l_partkey") % 7).alias("p2")).distinct()
    return G.lineage(s.select("support", "claim", "derived"), s.select("support", F.explode(F.array("p1", "p2")).alias("print")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 3 + 1 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 2 + 5 FROM part), r(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = r.node WHERE hops < 5), b AS (SELECT node, min(hops)::INT AS hops FROM r GROUP BY node)
SELECT node, hops, max(l_quantity) AS cost FROM b LEFT JOIN lineitem ON l_partkey = node GROUP BY node, hops""")
def requires_impact(t):
    p = F.col("p_partkey")
    edges = t("part").select(p.alias("src"), F.explode(F.array(p * 3 + 1, p * 2 + 5)).alias("dst"))
    reached = G.reach(edges, t("part").where("p_partkey = 1").select(p.alias("node")), 5)
    return G.impacts(reached, t("lineitem").select(F.col("l_partkey").alias("node"), F.col("l_quantity").alias("cost"))).select("node", "hops", "cost")


# --- the later steps of retrieval ---

_TERMS = r"regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(rf"SELECT doc_id, (4 * list_contains({_TERMS.format('source')}, 'src0')::INT + 4 * list_contains({_TERMS.format('source')}, 'license')::INT + list_contains({_TERMS.format('text')}, 'src0')::INT + list_contains({_TERMS.format('text')}, 'license')::INT) AS score FROM documents")
def search_terms(t):
    return t("documents").select("doc_id", Q.term_score(t("documents"), "SRC0 license src0", "source", "text").alias("score"))


@query("""WITH p AS (SELECT doc_id, text, CASE WHEN strpos(lower(text), 'license') > 0 THEN strpos(lower(text), 'license') WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') END AS i FROM documents), q AS (SELECT *, greatest(0, i - 41) AS a, least(length(text), i + 79) AS b FROM p)
SELECT doc_id, CASE WHEN i IS NULL THEN CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 160) || '…' END ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, b - a) || CASE WHEN b < length(text) THEN '…' ELSE '' END END AS snippet FROM q""")
def search_snippet(t):
    return t("documents").select("doc_id", Q.snippet(F.col("text"), ["license", "the"]).alias("snippet"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(upper(p_name)), 'e') AND p_partkey > 100 ORDER BY p_partkey LIMIT 32")
def label_page(t):
    return Q.label_matches(t("part"), "E", "p_partkey", "p_name", after=100).select("p_partkey", "p_name")


@query(f"WITH s AS (SELECT c_custkey, len(list_intersect(list_distinct({_WORDS.format('c_mktsegment')}), ['building', 'machinery', 'task'])) AS overlap FROM customer) SELECT c_custkey, overlap FROM s WHERE overlap > 0")
def slice_relevance(t):
    return Q.slice_relevance(t("customer"), "task Building machinery", "c_mktsegment", "c_custkey").select("c_custkey", F.col("overlap").cast("long").alias("overlap"))


@query("SELECT o_orderkey, contains(lower(o_orderpriority), 'high')::INT + contains(lower(o_orderpriority), 'o')::INT + contains(lower(o_orderstatus), 'high')::INT + contains(lower(o_orderstatus), 'o')::INT AS relevance FROM orders ORDER BY relevance DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def claim_relevance(t):
    rows = t("orders").withColumn("relevance", Q.term_relevance(t("orders"), "o high", ["o_orderpriority", "o_orderstatus"]))
    return rows.orderBy(F.desc("relevance"), F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "relevance")


_NEAR = "SELECT id, rank, similarity FROM (SELECT vec_id AS id, s AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS s FROM embeddings)) WHERE rank <= 100"


@query(f"""WITH c AS ({_NEAR}), z AS (SELECT count(*) AS z FROM embeddings), e AS (SELECT vec_id AS src, vec_id * 7 % z AS dst FROM embeddings, z UNION ALL SELECT vec_id, vec_id * 3 % z FROM embeddings, z UNION ALL SELECT vec_id, (vec_id + 1) % z FROM embeddings, z), b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
 n AS (SELECT src AS id, count(*) AS n FROM b WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c) GROUP BY src) SELECT id, coalesce(n, 0) AS neighbours, round(similarity * CASE WHEN coalesce(n, 0) >= 2 THEN 1.1::DOUBLE ELSE 1 END, 6) AS score FROM c LEFT JOIN n USING (id)""")
def adjacency_boost(t):
    v, z = F.col("vec_id"), t("embeddings").count()
    edges = t("embeddings").select(v.alias("src"), F.explode(F.array(v * 7 % z, v * 3 % z, (v + 1) % z)).alias("dst"))
    boosted = Q.adjacency_boost(_similar(t, 100).withColumn("score", F.col("similarity")), edges, "id", "score")
    return boosted.select("id", "neighbours", F.round("score", 6).alias("score"))


@query(f"""WITH c AS (SELECT conv_id AS id, turn AS chunk, role AS kind, text, (conv_id * 31 + turn * 17) % 101 AS score, turn % 9 = 8 AS corrected, list_distinct({_WORDS.format('text')}) AS t FROM conversations),
 d AS (SELECT DISTINCT b.id, b.chunk FROM c a JOIN c b ON a.id = b.id AND (a.score > b.score OR (a.score = b.score AND a.chunk < b.chunk)) WHERE len(list_intersect(a.t, b.t)) >= 0.85::DOUBLE * len(list_distinct(list_concat(a.t, b.t))) AND len(a.t) + len(b.t) > 0),
 p AS (SELECT * FROM c WHERE (id, chunk) NOT IN (SELECT id, chunk FROM d)), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, -chunk DESC, id) <= (SELECT ceil(count(*) * 0.6) FROM c)),
 x AS (SELECT * FROM c WHERE corrected AND id NOT IN (SELECT id FROM k WHERE corrected) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) = 1) SELECT id, chunk, score FROM k UNION ALL SELECT id, chunk, score FROM x""")
def layered_dedup(t):
    i, n = F.col("conv_id"), F.col("turn")
    rows = t("conversations").select(i.alias("id"), n.alias("chunk"), F.col("role").alias("kind"), "text", ((i * 31 + n * 17) % 101).alias("score"), (n % 9 == 8).alias("corrected"))
    return Q.layered(rows).select("id", "chunk", "score")


@query("SELECT conv_id, arg_max(turn, ((conv_id * 31 + turn * 17) % 101, -turn)) AS turn FROM conversations GROUP BY conv_id")
def collapse_chunks(t):
    return Q.collapsed(t("conversations").withColumn("score", (F.col("conv_id") * 31 + F.col("turn") * 17) % 101), "conv_id", "score", "turn").select("conv_id", "turn")


@query(f"WITH c AS ({_NEAR}) SELECT id, row_number() OVER (ORDER BY CASE WHEN id % 3 > 0 THEN id % 10 END DESC NULLS LAST, rank, id) AS place FROM (SELECT * FROM c ORDER BY rank LIMIT 63)")
def rerank_judged(t):
    judged = t("embeddings").where("vec_id % 3 > 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10).alias("judged"))
    best = Q.reranked(_similar(t, 100), judged, "id")
    from pyspark.sql import Window

    return best.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("judged"), "rank", "id")).alias("place"))  # of 63 rows


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3 AND o_custkey % 50 <> 7")
def index_erase(t):
    index = t("orders").select("o_orderkey", F.array("o_custkey", F.lit(-1).cast("long")).alias("provenance"))
    gone = t("orders").select(F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_custkey") % 50 == 7, F.col("o_custkey")).alias("event"))
    kept = Q.erased(index, gone, "o_orderkey", "provenance")
    return kept.join(Q.absent(kept, gone, "o_orderkey", "provenance").select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cited_folding(t):
    pages = t("orders").where("o_orderpriority = '1-URGENT'").select(F.array("o_orderkey", "o_custkey").alias("sources"))
    return Q.unfolded(t("events").select("event_id"), pages, "event_id", "sources")


@query(r"""WITH g AS (SELECT s_suppkey, list_distinct(list_transform(range(1, length(s_name) + 2), lambda i: substr('  ' || lower(s_name) || ' ', i, 3))) AS a FROM supplier), q AS (SELECT a AS b FROM g WHERE s_suppkey = 7)
SELECT s_suppkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g, q WHERE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) >= 0.2""")
def trigram_similarity(t):
    own = t("supplier").select("s_suppkey", S.trigrams(F.col("s_name")).alias("a"))
    asked = own.where("s_suppkey = 7").select(F.col("a").alias("b"))
    both = own.crossJoin(F.broadcast(asked)).select("s_suppkey", S.jaccard(F.col("a"), F.col("b")).alias("similarity"))
    return both.where("similarity >= 0.2").withColumn("similarity", F.round("similarity", 6))


# --- reports ---


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS used, count(*) AS n FROM events GROUP BY ALL")
def budget_daily(t):
    return R.spent(t("events"), "ts", "event_type", "value").withColumn("used", F.round("used", 4))


@query("SELECT event_type, round(avg((value > 20)::INT), 6) AS recall, round(avg((event_id % 9 = 0)::INT), 6) AS stale_rate, sum((event_id % 101 = 0)::INT)::BIGINT AS leaks, round(avg((event_id % 4 > 0)::INT), 6) AS provenance_rate, round(avg(event_id % 300), 6) AS tokens FROM events GROUP BY event_type")
def agent_metrics(t):
    e = F.col("event_id")
    rows = t("events").withColumns({"found": F.col("value") > 20, "stale": e % 9 == 0, "leaked": e % 101 == 0, "sourced": e % 4 > 0, "tokens": e % 300})
    return R.agent_metrics(rows, "event_type").select("event_type", "leaks", *(F.round(c, 6).alias(c) for c in ("recall", "stale_rate", "provenance_rate", "tokens")))


@query("""SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n <= 5) WHERE running <= 1000""")
def session_sections(t):
    return R.sections(t("conversations").withColumn("cost", F.length("text")), "conv_id", "role", ["turn"], "cost", 2000).select("conv_id", "turn")


@query("SELECT a.o_orderkey AS old_id, b.o_orderkey AS new_id, greatest(a.o_orderdate, b.o_orderdate) AS starts, least(a.o_orderdate, b.o_orderdate) + INTERVAL 90 DAY AS ends FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE greatest(a.o_orderdate, b.o_orderdate) < least(a.o_orderdate, b.o_orderdate) + INTERVAL 90 DAY")
def interval_intersection(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("starts"), F.expr("o_orderdate + INTERVAL 90 DAY AS ends"))
    return C.intersections(rows, "o_custkey", "o_orderkey", "starts", "ends")


def health(t) -> DataFrame:
    """Row counts of what a reader may see, by table."""
    one = lambda name, rows: rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return one("events", L.live(_ledger(t), "record")).unionByName(one("pages", t("pages"))).unionByName(one("documents", t("documents")))


@query(f"{_LIVE} SELECT 'events' AS part, count(*) AS n FROM live UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'documents', count(*) FROM documents")
def system_health(t):
    return health(t)
