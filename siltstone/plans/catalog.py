"""Queries over the ledger, policy, search, graph, claims and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import claims as C
from siltstone.operators import graph as G
from siltstone.operators import ledger as L
from siltstone.operators import policy as P
from siltstone.operators import reports as R
from siltstone.operators import search as Q
from siltstone.operators import timeline as T
from siltstone.plans.registry import query
from siltstone.sources import recurrence as RR
from siltstone.sources import rows as X

_LEDGER = """SELECT event_id, ts AS accepted_at, user_id AS record, event_type AS kind, value, props, event_type = 'error' AS deleted,
 CASE WHEN event_id % 4 < 3 THEN (event_id % 4)::INT END AS sensitivity FROM events"""
_LIVE = f"""WITH l AS ({_LEDGER}), live AS (SELECT * FROM l a WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM l t WHERE t.deleted AND t.record = a.record
 AND (t.accepted_at > a.accepted_at OR (t.accepted_at = a.accepted_at AND t.event_id > a.event_id))))"""


def _ledger(t) -> DataFrame:
    return L.from_events(t("events"))


@query(f"{_LIVE} SELECT event_id, record, kind FROM live")
def ledger_live(t):
    return L.live(_ledger(t), "record").select("event_id", "record", "kind")


@query(f"WITH l AS ({_LEDGER}) SELECT event_id, record, kind FROM (SELECT *, row_number() OVER (PARTITION BY record, kind ORDER BY accepted_at DESC, event_id DESC) n FROM l WHERE sensitivity <= 1 AND NOT deleted) WHERE n = 1")
def ledger_current_version(t):
    scoped = _ledger(t).where(P.within_ceiling(F.col("sensitivity"), 1) & ~F.col("deleted"))
    return L.current(scoped, "record", "kind").select("event_id", "record", "kind")


@query(f"WITH l AS ({_LEDGER}) SELECT record, kind, props, arg_min(event_id, (accepted_at, event_id)) AS event_id, count(*) AS n_seen FROM l GROUP BY ALL")
def ledger_dedup(t):
    return L.deduplicated(_ledger(t), "record", "kind", "props")


@query(f"WITH l AS ({_LEDGER}), b AS (SELECT DISTINCT record, kind, props FROM l WHERE event_id % 2 = 0) SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE event_id % 2 = 1 AND l.record = b.record AND l.kind = b.kind AND l.props = b.props)")
def ledger_accept(t):
    rows = _ledger(t)
    return L.accept(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "record", "kind", "props").select("record", "kind", "props")


@query(f"WITH l AS ({_LEDGER}) SELECT event_id, accepted_at FROM l WHERE (accepted_at, event_id) > (TIMESTAMP '2024-01-03 00:00:00', 0) ORDER BY accepted_at, event_id LIMIT 100")
def ledger_read_since(t):
    return L.read_since(_ledger(t), F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00")), 0, 100).select("event_id", "accepted_at")


@query(f"WITH l AS ({_LEDGER}) SELECT record, event_id, versions, deleted FROM (SELECT *, count(*) OVER (PARTITION BY record) versions, row_number() OVER (PARTITION BY record ORDER BY accepted_at DESC, event_id DESC) n FROM l) WHERE n = 1")
def record_history(t):
    return L.history(_ledger(t), "record").select("record", "event_id", "versions", "deleted")


@query(f"WITH l AS ({_LEDGER}) SELECT kind, count(*) AS n_rows, count(DISTINCT record) AS n_records FROM l WHERE record % 7 = 3 OR kind = 'error' GROUP BY kind")
def purge_preview(t):
    return L.purge(_ledger(t), (F.col("record") % 7 == 3) | (F.col("kind") == "error"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' ORDER BY ts, event_id LIMIT 200")
def timeline_day(t):
    return T.page(t("events").where(T.day_window(F.col("ts"), "2024-01-02")), "ts", "event_id", 200).select("event_id", "ts", "event_type")


@query("SELECT event_id, ts, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-02 12:00:00', 100) ORDER BY ts, event_id LIMIT 50")
def timeline_keyset(t):
    return T.page(t("events"), "ts", "event_id", 50, after=("2024-01-02 12:00:00", 100)).select("event_id", "ts", "event_type")


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160) AS preview FROM documents")
def timeline_preview(t):
    return t("documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, substr(text, 11, 80) AS slice, sha256(text) AS integrity FROM documents")
def text_expand(t):
    s = S.text_slice(F.col("text"), F.lit(10), F.lit(80))
    return t("documents").select("doc_id", s["slice"].alias("slice"), s["integrity"].alias("integrity"))


# nulls stand in every column that a check needs
_ASKED = f"""SELECT event_id, sensitivity, CASE WHEN event_id % 13 > 0 THEN kind END AS kind, CASE WHEN event_id % 17 > 0 THEN [record, record % 10] END AS subjects,
 CASE WHEN event_id % 19 > 0 THEN accepted_at END AS seen_at, event_id % 23 = 0 AS held FROM ({_LEDGER})"""
_DENY = """CASE WHEN held THEN 'held' WHEN sensitivity IS NULL THEN 'missing_sensitivity' WHEN sensitivity > 1 THEN 'above_ceiling' WHEN kind = 'purchase' THEN 'class_denied'
 WHEN kind IS NULL OR kind NOT IN ('click', 'view', 'purchase') THEN 'type_out_of_scope' WHEN subjects IS NULL OR NOT list_has_any(subjects, [1, 2, 3, 4, 5, 6]) THEN 'subject_out_of_scope'
 WHEN seen_at IS NULL OR seen_at < TIMESTAMP '2024-01-02' OR seen_at > TIMESTAMP '2024-01-20' THEN 'time_out_of_scope' END"""


def _denied(t):
    e = F.col("event_id")
    some = lambda n, column: F.when(e % n > 0, column)
    rows = _ledger(t).withColumns({"kind": some(13, F.col("kind")), "subjects": some(17, F.array(F.col("record"), F.col("record") % 10)), "at": some(19, F.col("accepted_at"))})
    grant = P.Grant(1, ("click", "view", "purchase"), ("credential",), (1, 2, 3, 4, 5, 6), "2024-01-02 00:00:00", "2024-01-20 00:00:00")
    classes = F.when(F.col("kind") == "purchase", F.array(F.lit("credential")))
    return rows.withColumn("deny_reason", P.deny_reason(grant, F.col("sensitivity"), F.col("kind"), classes, F.col("subjects"), F.col("at"), e % 23 == 0))


@query(f"SELECT event_id, {_DENY} AS deny_reason FROM ({_ASKED})")
def policy_authorize(t):
    return _denied(t).select("event_id", "deny_reason")


@query(f"SELECT coalesce({_DENY}, 'served') AS reason, count(*) AS n FROM ({_ASKED}) GROUP BY 1")
def policy_nonserved_summary(t):
    return _denied(t).groupBy(F.coalesce("deny_reason", F.lit("served")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <= 1)")
def policy_source_grants(t):
    grants = t("customer").select(F.col("c_custkey").alias("source"), (F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("recall"))).otherwise(F.array().cast("array<string>")).alias("purposes"), (F.col("c_nationkey") % 3).alias("floor"))
    return P.source_allows(t("orders").withColumnRenamed("o_custkey", "source"), grants, "recall", 1).select("o_orderkey")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE greatest(coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 3 END, 2), CASE WHEN event_type = 'error' THEN 2 ELSE 0 END,
 CASE WHEN event_id % 7 = 0 THEN user_id % 3 END, user_id % 2, CASE WHEN event_id % 22 = 1 THEN 1 END) END::BIGINT AS sensitivity FROM events""")
def sensitivity_resolve(t):
    e, u = F.col("event_id"), F.col("user_id")
    owner = F.when(e % 11 == 0, 0).when(e % 22 == 1, 1)
    got = P.resolved_sensitivity(F.when(e % 5 > 0, e % 3), F.when(F.col("event_type") == "error", 2).otherwise(0), F.when(e % 7 == 0, u % 3), u % 2, owner, e % 11 == 0)
    return t("events").select("event_id", got.cast("long").alias("sensitivity"))


@query("""WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS us, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_window,
 lag(epoch_us(ts), 2) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS back FROM events)
SELECT event_id, n_window, n_window > 2 AS limited, CASE WHEN n_window > 2 THEN greatest(0, ceil((back + 3600000000 - us) / 1000000.0)) ELSE 0 END::BIGINT AS retry_after FROM w""")
def rate_window(t):
    return P.rate(t("events"), "user_id", "ts", 3600, 2).select("event_id", "n_window", "limited", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


_WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
_N = "len(list_filter({0}, lambda x: x = '{1}'))"
_STARTS = "len(list_filter({0}, lambda x: starts_with(x, '{1}')))"
# a document's first line is its title, the rest its body; some are pages that a machine wrote
_PAGES = r"SELECT doc_id, lang, text, split_part(text, chr(10), 1) AS title, doc_id % 5 = 0 AS machine FROM documents"


def _pages(t):
    return t("documents").select("doc_id", "lang", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (F.col("doc_id") % 5 == 0).alias("machine"))


@query(f"""WITH p AS ({_PAGES}), w AS (SELECT *, {_WORDS.format('text')} AS b, {_WORDS.format('title')} AS h FROM p),
 c AS (SELECT *, {_N.format('b', 'the')} AS b1, {_STARTS.format('b', 'an')} AS b2, {_N.format('h', 'the')} AS h1, {_STARTS.format('h', 'an')} AS h2 FROM w)
SELECT doc_id, exact, score FROM (SELECT doc_id, lower(trim(title)) = 'the an*' AS exact, round((4 * (h1 + h2) / (1.0::DOUBLE + h1 + h2) + (b1 + b2) / (1.0::DOUBLE + b1 + b2)) / (1000 + least(length(text), 1000)) * CASE WHEN machine THEN 0.5::DOUBLE ELSE 1 END, 12) AS score
 FROM c WHERE b1 + h1 > 0 AND b2 + h2 > 0) ORDER BY exact DESC, score DESC, doc_id LIMIT 20""")
def scan_literal(t):
    docs = _pages(t).withColumn("score", F.lit(0))
    found = Q.literal(docs, "the an*", "title", "text", "doc_id", 60, F.col("machine")).withColumn("score", F.round("score", 12))
    return found.orderBy(F.desc("exact"), F.desc("score"), "doc_id").limit(20).select("doc_id", "exact", "score")


_QUESTION = "What did we decide about the license of these thing passages?"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), c AS (SELECT doc_id, (({_STARTS.format('w', 'decid')} + {_STARTS.format('w', 'decision')}) > 0)::INT + ({_STARTS.format('w', 'licens')} > 0)::INT
 + ({_STARTS.format('w', 'thing')} > 0)::INT + ({_STARTS.format('w', 'passag')} > 0)::INT AS covered FROM w)
SELECT doc_id, covered, round(covered / 4, 6) AS coverage FROM c WHERE covered >= 1""")
def scan_relaxed(t):
    terms, need = Q.relaxed_terms(_QUESTION)
    assert (len(terms), need) == (4, 3)
    found = Q.relaxed(t("documents"), terms, need - 2, "text")  # one term is enough here, so that rows are found
    return found.select("doc_id", "covered", F.round("coverage", 6).alias("coverage"))


_TF = "(len(list_filter(w, lambda x: x = '{0}')) + 4 * len(list_filter(h, lambda x: x = '{0}')))::DOUBLE"


@query(rf"""WITH p AS ({_PAGES}), w AS (SELECT doc_id, {_WORDS.format('text')} AS w, {_WORDS.format('title')} AS h FROM p), c AS (SELECT doc_id, (len(w) + 4 * len(h))::DOUBLE AS n, {_TF.format('the')} AS a, {_TF.format('license')} AS b FROM w),
 s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM c, s WHERE a + b > 0""")
def scan_bm25(t):
    return Q.bm25(_pages(t), ["the", "license"], "doc_id", "text", "title").select("doc_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20")
def vector_topk(t):
    vectors = t("embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    found = Q.nearest(vectors, first[0] if first else [1.0], "vec_id", "embedding", 20)
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


_COS = "round(list_cosine_similarity({0}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


def _similar(t, limit):
    vectors = t("embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    near = vectors.select(F.col("vec_id").alias("id"), F.round(S.cosine(F.col("embedding"), F.lit([float(x) for x in first[0]] if first else [1.0])), 6).alias("similarity"))
    return Q.ranked(near, "similarity", "id", limit)


_HYBRID = f"""WITH w AS (SELECT doc_id AS id, {_N.format(_WORDS.format('text'), 'the')} AS n FROM documents),
 a AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM w WHERE n > 0 QUALIFY rank <= 200), v AS (SELECT vec_id AS id, {_COS.format('embedding')} AS similarity FROM embeddings),
 b AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM v QUALIFY rank <= 200),
 f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS raw, count(*) AS n_lists, max(similarity) AS similarity FROM (SELECT id, rank, NULL AS similarity FROM a UNION ALL SELECT id, rank, similarity FROM b) GROUP BY id),
 g AS (SELECT id, n_lists, similarity, raw / (SELECT max(raw) FROM f) * CASE id % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 2.0 END AS fused FROM f)
SELECT id, round(fused, 8) AS fused, n_lists, round(0.7::DOUBLE * fused / (SELECT max(fused) FROM g) + 0.3::DOUBLE * coalesce(similarity, 0), 6) AS score FROM g"""


@query(_HYBRID)
def scan_hybrid(t):
    words = t("documents").select(F.col("doc_id").alias("id"), Q.spans(F.col("text"), "the").alias("n")).where("n > 0")
    return _hybrid(t, words)


def _hybrid(t, words):
    fused = Q.weighted(Q.fused([Q.ranked(words, "n", "id", 200), _similar(t, 200)], "id", carry=("similarity",)), (F.col("id") % 4 + 1).cast("int"))
    return Q.rescored(fused, "fused", "similarity").select("id", F.round("fused", 8).alias("fused"), "n_lists", F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
 k AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 20) / 80.0)::INT - 1) + 1)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::BIGINT AS chunk, len(w[chunk * 80 + 1 : chunk * 80 + 100])::BIGINT AS n_words, array_to_string(w[chunk * 80 + 1 : chunk * 80 + 100], ' ') AS text FROM k""")
def chunk_documents(t):
    return Q.chunks(t("documents"), "doc_id", "text", 100, 20)


_SETS = f"""SELECT min(doc_id) AS k, t FROM (SELECT doc_id, list_sort(list_distinct({_WORDS.format('text')})) AS t FROM documents) GROUP BY t"""


@query(f"""WITH n AS (SELECT * FROM ({_SETS}) WHERE len(t) > 0), p AS (SELECT a.k AS left_id, b.k AS right_id, a.t AS x, b.t AS y FROM n a JOIN n b ON a.k < b.k AND len(a.t) >= 0.7::DOUBLE * len(b.t) AND len(b.t) >= 0.7::DOUBLE * len(a.t))
SELECT left_id, right_id, round(similarity, 6) AS similarity FROM (SELECT left_id, right_id, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS similarity FROM p) WHERE similarity >= 0.7::DOUBLE""")
def near_claim_pairs(t):
    return Q.near_claims(t("documents"), "doc_id", "text", 0.7)[0].withColumn("similarity", F.round("similarity", 6))


@query(f"WITH n AS (SELECT doc_id, list_sort(list_distinct({_WORDS.format('text')})) AS t FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS set_id FROM n")
def near_claim_members(t):
    return Q.near_members(t("documents"), "doc_id", "text")


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_WORDS.format('text')})) AS w FROM documents), df AS (SELECT w, count(*) AS n FROM t GROUP BY w), p AS (SELECT item_id, unnest(list_distinct({_WORDS.format('text')})) AS w FROM benchmark),
 r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY n, w) AS k FROM p JOIN df USING (w)), m AS (SELECT item_id, doc_id, count(*) AS s FROM r JOIN t USING (w) WHERE k <= 8 GROUP BY ALL),
 k AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM m), a AS (SELECT item_id, min(rank) AS rank FROM k JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE contains(d.text, b.text) GROUP BY item_id)
SELECT CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS kind, count(*) AS n, round(avg((coalesce(rank, 1000000) <= 1)::INT::DOUBLE), 6) AS hit_1, round(avg((coalesce(rank, 1000000) <= 5)::INT::DOUBLE), 6) AS hit_5, round(avg((coalesce(rank, 1000000) <= 20)::INT::DOUBLE), 6) AS hit_20,
 round(avg((rank IS NULL)::INT::DOUBLE), 6) AS abstained, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM benchmark LEFT JOIN a USING (item_id) GROUP BY 1""")
def search_eval_metrics(t):
    """Each passage asks for its eight rarest words; the rank of the first document that holds the passage counts."""
    docs, items = t("documents").select("doc_id", "text"), t("benchmark")
    words = docs.select("doc_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("w"))
    asked = items.select("item_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("w"))
    counts = words.join(F.broadcast(asked.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the passages have words
    rare = asked.join(counts, "w").withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "w"))).where("k <= 8").select("item_id", "w")
    met = words.join(rare, "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("s"))
    found = met.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("s"), "doc_id")))
    # a document that holds the passage holds all of its words: only such are looked at, and their texts with them
    whole = found.join(rare.groupBy("item_id").agg(F.count(F.lit(1)).alias("all")), "item_id").where(F.col("s") == F.col("all"))
    held = whole.join(items.withColumnRenamed("text", "passage"), "item_id").join(docs, "doc_id").where(F.contains("text", "passage")).groupBy("item_id").agg(F.min("rank").alias("rank"))
    ranks = items.join(held, "item_id", "left").withColumn("kind", F.when(F.length("text") > 200, "long").otherwise("short"))
    m = Q.eval_metrics(ranks, "kind", "rank")
    return m.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "hit_20", "abstained", "mrr")))


_HREF = r"""SELECT page_id AS src, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1))) AS target FROM pages"""


@query(f"""WITH l AS ({_HREF}), t AS (SELECT page_id, lower(regexp_extract(html, '<title>([^< ]+)', 1)) AS name FROM pages), u AS (SELECT name, min(page_id) AS page FROM t WHERE name <> '' GROUP BY name HAVING count(DISTINCT page_id) = 1)
SELECT DISTINCT src, coalesce(page::VARCHAR, target) AS dst FROM l LEFT JOIN u ON lower(target) = name""")
def graph_project(t):
    pages = t("pages")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), F.lit(1)))).alias("target"))
    title = F.regexp_extract("html", r"<title>([^< ]+)", 1)
    named = pages.select("page_id", F.filter(F.array(title), lambda x: x != "").alias("names"))
    return G.resolved(links, named)


_EDGES = "SELECT DISTINCT l_suppkey AS src, -1 - l_partkey AS dst FROM lineitem"


def _edges(t):
    return t("lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")).distinct()


@query(f"WITH e AS ({_EDGES}) SELECT src, dst FROM e WHERE src = 7 ORDER BY src, dst LIMIT 100")
def graph_neighbors_1(t):
    start = t("supplier").where("s_suppkey = 7").select(F.col("s_suppkey").alias("node"))
    return G.incident(_edges(t), start, 100).select("src", "dst")


@query(f"""WITH e AS ({_EDGES}), b AS (SELECT src AS node, dst AS next FROM e UNION ALL SELECT dst, src FROM e), h1 AS (SELECT DISTINCT next AS node, 1 AS hops FROM b WHERE node = 7),
 h2 AS (SELECT DISTINCT next AS node, 2 AS hops FROM b JOIN h1 USING (node)) SELECT node, min(hops)::INT AS hops FROM (SELECT 7 AS node, 0 AS hops UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node""")
def graph_neighbors_2(t):
    start = t("supplier").where("s_suppkey = 7").select(F.col("s_suppkey").alias("node"))
    return G.walk(_edges(t), start, 2)


@query("""WITH RECURSIVE e AS (SELECT p.p_partkey AS src, c.p_partkey AS dst FROM part p JOIN part c ON c.p_partkey IN (p.p_partkey * 2 + 1, p.p_partkey * 2 + 2, p.p_partkey // 3)), r(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 8),
 b AS (SELECT node, min(hops) AS hops FROM r GROUP BY node) SELECT b.node, b.hops::INT AS hops, coalesce((SELECT min(e.src) FROM e JOIN b q ON e.src = q.node WHERE e.dst = b.node AND q.hops = b.hops - 1), -1) AS parent FROM b""")
def graph_reach_recursive(t):
    p = F.col("p_partkey")
    parts = t("part").select(p.alias("dst"))
    edges = t("part").select(p.alias("src"), F.explode(F.array(p * 2 + 1, p * 2 + 2, F.floor(p / 3))).alias("dst")).join(parts.hint("merge"), "dst", "left_semi").select("src", "dst")
    return G.reach(edges, parts.where("dst = 0").select(F.col("dst").alias("node")), 8).withColumn("parent", F.coalesce("parent", F.lit(-1)))


_ALIKE = """SELECT c_custkey AS a, min(c_custkey) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 100)) AS b FROM customer UNION ALL SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment, floor(c_acctbal / 5)) FROM customer"""


def _alike(t):
    first = lambda *by: F.min("c_custkey").over(Window.partitionBy(*by)).alias("b")
    c = t("customer")
    one = c.select(F.col("c_custkey").alias("a"), first("c_nationkey", F.floor(F.col("c_acctbal") / 100)))
    return one.unionByName(c.select(F.col("c_custkey").alias("a"), first("c_mktsegment", F.floor(F.col("c_acctbal") / 5))))


@query(f"""WITH RECURSIVE l AS ({_ALIKE}), b AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
 r(node, seen) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, r.seen FROM r JOIN b ON b.x = r.node) SELECT node, min(seen) AS cluster FROM r GROUP BY node""")
def identity_components(t):
    return G.clusters(_alike(t))


_CLAIMS = """SELECT o_orderkey AS claim_id, o_custkey * 2 + o_orderkey % 2 AS claim_key, o_orderstatus AS object, o_orderdate AS valid_from, CASE WHEN o_orderkey % 7 = 0 THEN 'negative' ELSE 'positive' END AS polarity, o_orderkey % 2 = 0 AS single,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 90 DAY END AS valid_to, (1 + o_orderkey // 2 % 4)::INT AS tier, (o_orderkey * 37 % 100) / 100.0::DOUBLE AS confidence FROM orders"""
_FAR = "coalesce({}, TIMESTAMP '9999-12-31')"
_PAIR = f"a.claim_key = b.claim_key AND a.claim_id < b.claim_id AND (a.polarity <> b.polarity OR a.single AND a.object <> b.object) AND a.valid_from < {_FAR.format('b.valid_to')} AND b.valid_from < {_FAR.format('a.valid_to')}"


def _claims(t):
    k = F.col("o_orderkey")
    ends = F.when(k % 5 != 0, F.expr("o_orderdate + INTERVAL 90 DAY"))
    polarity = F.when(k % 7 == 0, "negative").otherwise("positive")
    return t("orders").select(
        k.alias("claim_id"), (F.col("o_custkey") * 2 + k % 2).alias("claim_key"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("valid_from"), polarity.alias("polarity"), (k % 2 == 0).alias("single"),
        ends.alias("valid_to"), (1 + F.floor(k / 2) % 4).cast("int").alias("tier"), ((k * 37 % 100) / 100.0).alias("confidence"),
    )


@query(f"WITH c AS ({_CLAIMS}) SELECT a.claim_id AS old_id, b.claim_id AS new_id FROM c a JOIN c b ON {_PAIR}")
def claim_conflicts(t):
    return C.conflicts(_claims(t)).select(F.col("a.claim_id").alias("old_id"), F.col("b.claim_id").alias("new_id"))


# a the live claim, b the incoming one: who comes later, and by how much the winner's confidence is the greater
_LATER = "b.valid_from > a.valid_from OR (b.valid_from = a.valid_from AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.claim_id > a.claim_id)))"
_RULE = f"""CASE WHEN a.claim_id % 29 = 0 THEN 'R6' WHEN b.tier = 4 THEN CASE WHEN a.tier = 4 THEN 'R3' ELSE 'R5' END WHEN a.tier = 4 THEN 'R1' WHEN b.tier = 1 AND a.tier >= 2 THEN 'R2' WHEN a.tier <> b.tier THEN 'R1'
 WHEN a.tier <= 2 AND CASE WHEN {_LATER} THEN b.confidence - a.confidence ELSE a.confidence - b.confidence END < 0.15::DOUBLE - 2.220446049250313e-16 THEN 'R4' ELSE 'R3' END"""
_DECIDED = f"""SELECT a.claim_id AS old_id, b.claim_id AS new_id, b.valid_from AS starts, {_RULE} AS rule, CASE WHEN {_LATER} THEN 'incoming' ELSE 'live' END AS later, a.tier AS ta, b.tier AS tb FROM c a JOIN c b ON {_PAIR}"""
_ACTED = f"""SELECT *, CASE rule WHEN 'R6' THEN 'supersede' WHEN 'R5' THEN 'supersede' WHEN 'R2' THEN 'skip' WHEN 'R4' THEN 'contested' WHEN 'R1' THEN CASE WHEN tb > ta THEN 'supersede' ELSE 'skip' END ELSE 'supersede' END AS action,
 CASE WHEN rule IN ('R6', 'R5') OR (rule = 'R1' AND tb > ta) THEN 'incoming' WHEN rule = 'R3' THEN later END AS winner FROM ({_DECIDED})"""


@query(f"WITH c AS ({_CLAIMS}) SELECT rule, action, winner, count(*) AS n FROM ({_ACTED}) GROUP BY ALL")
def claim_resolution(t):
    settled = C.conflicts(_claims(t)).select(C.resolution(F.col("a.claim_id") % 29 == 0).alias("r"))
    return settled.groupBy("r.rule", "r.action", "r.winner").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT * REPLACE (CASE WHEN claim_id % 9 > 0 THEN valid_from END AS valid_from) FROM ({_CLAIMS})), k AS (SELECT claim_id, claim_key, polarity, single, object, coalesce(valid_from, TIMESTAMP '0001-01-01') AS valid_from, CASE WHEN valid_from IS NOT NULL THEN valid_to END AS valid_to FROM c),
 p AS (SELECT a.claim_id AS x, b.claim_id AS y FROM k a JOIN k b ON {_PAIR}) SELECT claim_id, CASE WHEN claim_id IN (SELECT x FROM p UNION ALL SELECT y FROM p) THEN 'present' WHEN valid_from IS NULL THEN 'unknown' ELSE 'none_observed' END AS conflict FROM c""")
def claim_enrich(t):
    return C.enriched(_claims(t).withColumn("valid_from", F.when(F.col("claim_id") % 9 > 0, F.col("valid_from"))))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_roots, max(l_discount) AS best, count(DISTINCT l_suppkey) < 2 AS held_back FROM lineitem GROUP BY l_partkey")
def claim_corroboration(t):
    return C.corroboration(t("lineitem"), "l_partkey", "l_suppkey", "l_discount")


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_key, gap_from, valid_from AS gap_to FROM (SELECT *, max({_FAR.format('valid_to')}) OVER (PARTITION BY claim_key ORDER BY valid_from, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_from FROM c) WHERE gap_from < valid_from")
def claim_gaps(t):
    return C.gaps(_claims(t))


@query(f"WITH c AS ({_CLAIMS}), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY claim_key ORDER BY valid_from, claim_id) AS nx FROM c) SELECT claim_id, least(valid_to, nx) AS ends, nx IS NOT NULL AS replaced FROM n")
def claim_supersede(t):
    return C.superseded(_claims(t)).select("claim_id", "ends", "replaced")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id <= 5000 GROUP BY user_id")
def known_as_of(t):
    return C.known_as_of(t("events"), "user_id", "event_id", 5000, "event_type", "value").select("user_id", "event_id", "event_type", "value")


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_id FROM c WHERE valid_from <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' < {_FAR.format('valid_to')}")
def valid_time_at(t):
    at = F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))
    return _claims(t).where((F.col("valid_from") <= at) & (at < C._end(F.col("valid_to")))).select("claim_id")


@query("SELECT l_orderkey, count(*) AS n_supports FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_discount <= 0.08)")
def support_for_all(t):
    return C.supported_by_all(t("lineitem"), "l_orderkey", F.col("l_discount") <= 0.08)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_roots, max(o_totalprice) AS best FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 2")
def held_until_corroborated(t):
    return C.corroboration(t("orders"), "o_custkey", "o_orderpriority", "o_totalprice").where("not held_back").drop("held_back")


@query("SELECT event_type, count(*) AS n_rows, min(ts) AS first_at, max(ts) AS last_at, count(*) - count(value) AS n_blind, CASE WHEN count(*) < 20 THEN 'sparse' WHEN count(*) > count(value) THEN 'blind' ELSE 'covered' END AS state FROM events GROUP BY event_type")
def coverage_report(t):
    return R.coverage(t("events"), "event_type", "ts", "value")


_FORECAST = "SELECT source, lang, doc_id, toxic AS y, round(avg(toxic) OVER (PARTITION BY source), 1) AS p, doc_id % 5 > 0 AS resolved, doc_id % 10 = 0 AS censored FROM documents JOIN labels USING (doc_id)"


@query(f"""SELECT lang, count(*) FILTER (resolved) AS n_resolved, count(*) FILTER (NOT resolved AND censored) AS n_censored, count(*) FILTER (NOT resolved AND NOT censored) AS n_open,
 CASE WHEN count(*) FILTER (resolved) >= 20 THEN round(avg((p - y) * (p - y)) FILTER (resolved), 6) END AS brier, count(*) FILTER (resolved AND ((p = 1 AND y = 0) OR (p = 0 AND y = 1))) AS certain_wrong FROM ({_FORECAST}) GROUP BY lang""")
def forecast_scores(t):
    rows = t("documents").join(t("labels"), "doc_id")
    rate = rows.groupBy("source").agg(F.round(F.avg("toxic"), 1).alias("p"))
    rows = rows.join(rate, "source").withColumns({"resolved": F.col("doc_id") % 5 > 0, "censored": F.col("doc_id") % 10 == 0})
    return C.brier(rows, "lang", F.col("p"), F.col("toxic")).withColumn("brier", F.round("brier", 6))


@query(f"""WITH c AS ({_CLAIMS}), n AS (SELECT * FROM c ORDER BY valid_from DESC, claim_id DESC LIMIT 10000), r AS (SELECT sum(o_custkey % 5 + 1) AS x, sum(o_custkey % 3) AS w, sum(o_custkey % 2) AS m FROM orders)
SELECT round(w / greatest(1, x), 6) AS write_rate, round(m / greatest(1, x), 6) AS dedup_rate, (SELECT count(*) FROM n WHERE claim_id % 4 > 0) AS sample, (SELECT round(stddev_samp(confidence), 6) FROM n WHERE claim_id % 4 > 0) AS spread,
 (SELECT count(*) FROM n WHERE claim_id % 4 > 0) >= 8 AND NOT (w / greatest(1, x) BETWEEN 0.4 AND 0.9) AS out_of_band FROM r""")
def calibration(t):
    c = F.col("o_custkey")
    runs = t("orders").select((c % 5 + 1).alias("extracted"), (c % 3).alias("written"), (c % 2).alias("merged"))
    claims = _claims(t).select("claim_id", F.col("valid_from").alias("asserted_at"), "confidence", (F.col("claim_id") % 4 == 0).alias("capped"))
    got = R.calibration(runs, claims, bands=(0.4, 0.9))
    return got.select(*(F.round(k, 6).alias(k) for k in ("write_rate", "dedup_rate")), "sample", F.round("spread", 6).alias("spread"), "out_of_band")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id ORDER BY n DESC, user_id LIMIT 8")
def top_subjects(t):
    events = t("events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.crossJoin(F.broadcast(last)).where(F.expr("ts >= last - INTERVAL 7 DAY"))
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(8)


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n, max(ts) AS last_at FROM events GROUP BY event_type ORDER BY last_at DESC, event_type LIMIT 10")
def daily_brief(t):
    out = t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))
    return out.orderBy(F.desc("last_at"), "event_type").limit(10)


@query("SELECT source, doc_id, running::BIGINT AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 50000")
def budget_running(t):
    return R.budget(t("documents"), "source", "doc_id", "n_chars", 50000).select("source", "doc_id", "running")


@query("WITH o AS (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), n AS (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1) SELECT o_custkey, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (o_custkey) WHERE o.v IS DISTINCT FROM n.v")
def world_diff(t):
    cut = F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))
    view = lambda keep: t("orders").where(keep).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("v"))
    return C.difference(view(F.col("o_orderdate") < cut), view(F.col("o_orderdate") >= cut), "o_custkey", "v")


@query("SELECT o_orderkey, cue FROM (SELECT o_orderkey, 'blocker' AS cue, 1 AS r FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'due', 2 FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O') ORDER BY r, o_orderkey LIMIT 16")
def attention_topk(t):
    o = t("orders")
    cue = lambda name, rank, keep: o.where(keep).select("o_orderkey", F.lit(name).alias("cue"), F.lit(rank).alias("r"))
    both = cue("blocker", 1, "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").unionByName(cue("due", 2, "o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'"))
    return both.orderBy("r", "o_orderkey").limit(16).select("o_orderkey", "cue")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS cost, turn % 4 = 3 AS due, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 4 <> 3, turn) AS k FROM conversations),
 r(conv_id, k, used, kept, turn) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, false, NULL::BIGINT FROM c UNION ALL SELECT c.conv_id, c.k, CASE WHEN r.used + c.cost <= 200 THEN r.used + c.cost ELSE r.used END, r.used + c.cost <= 200, c.turn FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1),
 z AS (SELECT *, max(used) OVER (PARTITION BY conv_id) AS total FROM r) SELECT conv_id, turn, total AS used FROM z WHERE kept""")
def packet_pack(t):
    rows = t("conversations").withColumns({"cost": F.ceil(F.length("text") / 4), "due": F.col("turn") % 4 == 3})
    return R.packed(rows, "conv_id", ["turn"], "cost", 200, mandatory="due")


_SECRET = r"""(?i)(secret|token|passw(or)?d|api[ _-]?key|private[ _-]?key|credential)[A-Za-z0-9_.-]{0,100}["'']?\s*[=:]\s*("(\\.|[^"\\\n])+"?|''(\\.|[^''\\\n])+''?|[^\s"'']+)"""


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '[0-9a-f]{{40}}')) AS n_hex, regexp_matches(text, '{_SECRET}') AS has_secret FROM documents""")
def redact_counts(t):
    named = [p for kind, p, _ in S.CREDENTIALS if kind == "secret_assignment"]
    hit = F.rlike("text", F.lit(named[0])) | F.rlike("text", F.lit(named[1])) | F.rlike("text", F.lit(named[2]))
    return t("documents").select("doc_id", F.regexp_count("text", F.lit("[0-9a-f]{40}")).cast("long").alias("n_hex"), hit.alias("has_secret"))


@query("SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def chat_thread_stats(t):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("n_chars"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(t):
    return t("pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("""SELECT 'crm' AS connector, c_custkey::VARCHAR AS record, CASE c_mktsegment WHEN 'BUILDING' THEN 'company' WHEN 'MACHINERY' THEN 'company' WHEN 'HOUSEHOLD' THEN 'person' END AS kind, c_name || chr(10) || c_mktsegment AS text,
 CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'kind_unmapped' END AS skip_reason FROM customer""")
def row_mapping(t):
    m = X.Mapping("crm", "c_custkey", kind_column="c_mktsegment", kinds={"BUILDING": "company", "MACHINERY": "company", "HOUSEHOLD": "person"}, text=("c_name", "c_mktsegment"))
    return X.mapped(t("customer"), m).select("connector", "record", "kind", "text", "skip_reason")


@query("SELECT event_id, n::BIGINT AS n, (ts::DATE + n::INT * 2)::DATE::VARCHAR AS day FROM (SELECT event_id, ts, unnest(range(0, 5)) AS n FROM events WHERE event_type = 'view') WHERE dayofweek((ts::DATE + n::INT * 2)::DATE) IN (1, 3)")
def recurrence_expand(t):
    views = t("events").where("event_type = 'view'")
    return X.recurrences(views, "event_id", "ts", F.lit(2), F.lit(5), F.array(F.lit(2), F.lit(4))).withColumn("day", F.col("day").cast("string"))


_RULES = (
    "FREQ=DAILY;INTERVAL=10;COUNT=20", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,TH;UNTIL=20260630T235959Z;WKST=SU", "FREQ=MONTHLY;BYDAY=2TU,-1FR", "FREQ=MONTHLY;BYMONTHDAY=31,-2", "FREQ=MONTHLY;INTERVAL=3",
    "FREQ=YEARLY;BYMONTH=2,11;BYDAY=-1SU", "FREQ=YEARLY;BYDAY=20MO", "FREQ=HOURLY;COUNT=5", "FREQ=MONTHLY;BYMONTHDAY=13;BYDAY=FR", "FREQ=YEARLY",
)


@query("""WITH p AS (SELECT p_partkey, p_partkey % 10 AS r, DATE '2024-01-01' + (p_partkey % 400)::INT AS s FROM part),
c AS (SELECT p_partkey, r, s, unnest(generate_series(s, DATE '2027-12-31', INTERVAL 1 DAY))::DATE AS d FROM p),
f AS (SELECT p_partkey, r, s, d FROM c WHERE CASE r
 WHEN 0 THEN (d - s) % 10 = 0 AND d - s < 200
 WHEN 1 THEN dayofweek(d) IN (1, 4) AND d <= DATE '2026-06-30' AND (((d - dayofweek(d)::INT) - (s - dayofweek(s)::INT)) // 7) % 2 = 0
 WHEN 2 THEN (dayofweek(d) = 2 AND day(d) BETWEEN 8 AND 14) OR (dayofweek(d) = 5 AND month(d + 7) <> month(d))
 WHEN 3 THEN day(d) = 31 OR (month(d + 1) = month(d) AND month(d + 2) <> month(d))
 WHEN 4 THEN day(d) = day(s) AND (month(d) + 12 - month(s)) % 3 = 0
 WHEN 5 THEN month(d) IN (2, 11) AND dayofweek(d) = 0 AND month(d + 7) <> month(d)
 WHEN 6 THEN dayofweek(d) = 1 AND (dayofyear(d) + 6) // 7 = 20
 WHEN 7 THEN false
 WHEN 8 THEN day(d) = 13 AND dayofweek(d) = 5
 ELSE day(d) = day(s) AND month(d) = month(s) END),
a AS (SELECT p_partkey, d FROM f WHERE d <> s + 10 UNION SELECT p_partkey, s + 3 FROM p WHERE r <> 7 UNION SELECT p_partkey, s FROM p WHERE r = 7)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY d) - 1)::INT AS n, d::VARCHAR AS day FROM a""")
def recurrence_rules(t):
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int"))
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("p_partkey") % len(_RULES)).cast("int") + 1)
    parts = t("part").select("p_partkey", start.alias("start"), rule.alias("rule")).withColumn("without", F.array(F.date_add("start", 10))).withColumn("more", F.array(F.date_add("start", 3)))
    return RR.expanded(parts, "p_partkey", "start", "rule", F.lit("2027-12-31"), "without", "more").withColumn("day", F.col("day").cast("string"))


@query("SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'view') WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 300)")
def setops(t):
    e = t("events")
    of = lambda keep: e.where(keep).select("user_id")
    return of("event_type = 'click'").unionByName(of("event_type = 'view'")).distinct().join(of("event_type = 'error' AND value > 300").distinct(), "user_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 3")
def topk_per_group(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return t("lineitem").withColumn("n", F.row_number().over(w)).where("n <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "n")


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AFRICA') GROUP BY n_name")
def star_join(t):
    nations = t("nation").join(t("region").where(F.col("r_name").isin("ASIA", "AFRICA")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def outer_join_lists(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), ",").alias("statuses"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "statuses")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40 AND l_returnflag = 'R')")
def anti_join(t):
    big = t("lineitem").where("l_quantity > 40 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return t("part").join(big, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY ALL")
def pricing_summary(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").alias("p95"),
    )


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k_sum FROM events GROUP BY event_type")
def json_extract(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k_sum"))


@query("SELECT event_id, prior_id FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv, value FROM events) WHERE value < pv")
def monotone_check(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t("events").withColumn("prior_id", F.lag("event_id").over(w)).withColumn("pv", F.lag("value").over(w))
    return rows.where(F.col("value") < F.col("pv")).select("event_id", "prior_id")
