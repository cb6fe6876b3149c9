"""What readers are shown, and the smaller rules of links, grants, claims and files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import claims, deferred, graph, policy, reports, serve
from siltstone.operators import ledger as L
from siltstone.sources import rows as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_wikilinks(spark):
    cases = {
        "see [[A|x]] and `[[B]]` and [[ C ]] [[A]]": ["A", "C"], "``a `[[no]]` b`` [[yes]]": ["yes"], "```\n[[no]]\n``` [[yes]]": ["yes"], "[[a [[b]] c]] [[d]]": ["d"], "[[a [[b [[c]] ]] d]] [[e]]": ["e"],
        "[[ a [[b]]": ["b"], "[[]] [[ ]] [[|x]]": [], "[[a]b]] [[c": ["a]b"], "no links": [], "a ` b [[c]]": ["c"], "[[two\nlines]]": ["two\nlines"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.links for r in rows.select("i", graph.wikilinks(F.col("t")).alias("links")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_links_by_id_then_path_then_title(spark):
    pages = spark.createDataFrame([("a", "x/a.md", "Alpha"), ("b", "alpha.md", "Beta"), ("c", "c.md", "beta"), ("d", "same", "a"), ("e", "same", "Unique")], "id string, path string, title string")
    links = spark.createDataFrame([("s", t) for t in ("a", "x/a", "alpha", "ALPHA", "beta", "same", " unique ", "none", " ")], "src string, target string")
    assert {r.target: r.dst for r in graph.resolved_pages(links, pages).collect()} == {"a": "a", "x/a": "a", "alpha": "b", "ALPHA": "a", "beta": None, "same": None, "unique": "e", "none": None}


def test_slugs_and_lines(spark):
    assert one(spark, F.array(*(S.slug(F.lit(t)) for t in ("Hello,  World!", "--.x_Ｙ.-", "Ärger", "***", "_a")))) == ["hello-world", "x_y", "rger", "page", "a"]
    assert one(spark, S.one_line(F.lit(" a\n\tb\x1b[0m  c\x85d "), 6)) == "a b [0"


def test_nearest_rank_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)])) for _ in range(500)] + [("c", 7)]
    got = {(r.g, r.share): r.v for r in reports.nearest_rank(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    for g in {g for g, _ in rows}:
        vs = sorted(v for g2, v in rows if g2 == g and v is not None)
        for share in (0.0, 0.5, 0.9, 1.0):
            assert got[g, share] == vs[max(1, -int(-share * len(vs) // 1)) - 1]
    assert reports.nearest_rank(spark.createDataFrame([], "g string, v int"), "g", "v", (0.5,)).count() == 0


def test_live_rows_of_a_null_record(spark):
    rows = spark.createDataFrame([(1, 1, None, False), (2, 2, None, True), (3, 3, None, False), (4, 1, "a", False), (5, 5, "b", True)], "event_id long, accepted_at long, record string, deleted boolean")
    assert sorted(r.event_id for r in L.live(rows, "record").collect()) == [3, 4]


def test_conflicts_of_a_hot_key_are_the_same_in_parts(spark, monkeypatch):
    monkeypatch.setattr(claims, "SPLIT", 7)
    rng = random.Random(2)
    rows = [(i, "hot" if i % 5 else f"k{i}", rng.choice("ab"), rng.randint(0, 30), 2, 0.5) for i in range(120)]
    c = spark.createDataFrame(rows, "claim_id long, claim_key string, object string, day int, tier int, confidence double")
    c = c.select("*", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, day)").alias("valid_from")).withColumn("valid_to", F.expr("valid_from + INTERVAL 3 DAY"))
    pairs = lambda d: sorted((r[0], r[1]) for r in d.select("a.claim_id", "b.claim_id").collect())
    assert pairs(claims.conflicts(c)) == pairs(claims.conflicts(c, parts=1)) != []
    assert claims.conflict_groups(c.withColumn("asserted_at", F.col("valid_from")), page=3).select("claim_key").distinct().count() == 1


def test_held_claims_and_field_changes(spark):
    c = spark.createDataFrame([(1, "identity.same_as", "x"), (2, "decision.made", "grants access"), (3, "decision.made", "lunch"), (4, "skill.has", "x"), (5, "identity.same_as", "x"), (6, "identity.handle_on", None)], "claim_id int, predicate string, object string")
    s = spark.createDataFrame([(1, "a", False, ""), (1, "b", False, ""), (2, "a", False, ""), (2, "a", False, ""), (4, "a", False, "the Audit"), (5, "a", True, "")], "claim_id int, source string, owner boolean, body string")
    assert sorted(r.claim_id for r in claims.held(c, s).collect()) == [2, 4, 6]
    old = spark.createDataFrame([(i, "x", None) for i in range(10)], "k int, a string, b string")
    new = spark.createDataFrame([(i, "y" if i % 2 else "x", "z" if i == 3 else None) for i in range(2, 12)], "k int, a string, b string")
    got = {(r.k, r.change): (r.fields, r.truncated) for r in claims.field_changes(old, new, "k", "a", "b", most=2).collect()}
    assert got == {(0, "removed"): ([], True), (1, "removed"): ([], True), (10, "added"): ([], True), (11, "added"): ([], True), (3, "changed"): (["a", "b"], True), (5, "changed"): (["a"], True)}
    assert not claims.field_changes(old, old, "k", "a", "b").count()


def test_grants_by_field_and_rows_without_a_source(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "source string")
    grants = spark.createDataFrame([("a", True, ["serve"], 1, ["text", "metadata"]), ("b", True, ["serve"], 1, ["text"])], "source string, active boolean, purposes array<string>, floor int, fields array<string>")
    seen = lambda **k: sorted(str(r.source) for r in policy.source_allows(rows, grants, "serve", 1, **k).collect())
    assert seen() == ["a", "b"] and seen(fields=("text", "metadata")) == ["a"] and seen(owner=True) == ["None", "a", "b"]


def test_deferred_inputs(spark):
    queue = spark.createDataFrame([(1, "a", 1, "m"), (2, "a", 0, "m"), (3, "b", 0, "m"), (4, None, 0, "old"), (5, "gone", 0, "m"), (6, "gone", 1, "m")], "event_id int, source string, checked_revision int, checked_binding string")
    grants = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "source string, revision int, may boolean")
    events = queue.select("event_id", "source")
    ready, noted = deferred.recheck(queue, grants, events, "m", F.col("may"))
    assert [r.event_id for r in ready.collect()] == [2, 4, 6] and {r.event_id: r.checked_revision for r in noted.collect()} == {1: 1, 2: 0, 3: 2, 4: 0, 5: 0, 6: 1}
    page = lambda after: [r.event_id for r in deferred.recheck(queue, grants, events, "m", F.col("may"), after=after, page=2)[0].collect()]
    assert page(2) == [4, 6] and page(6) == [2, 4]
    with pytest.raises(ValueError):
        deferred.recheck(queue, grants, events.where("event_id <> 4"), "m", F.col("may"))


def test_search_tool_labels_and_recheck(spark):
    pages = spark.createDataFrame([(1, "Key", "my password: hunter2 is here", "p1", "note", "public", None, "x", ["s"], None), (2, "Other", "hunter hides", "p2", "note", "private", None, "x", None, None)], "id int, title string, body string, path string, type string, sensitivity string, taint string, authority string, subjects array<string>, sources array<string>")
    events = spark.createDataFrame([(7, "chat", "msg", "hunter seen", None, None)], "event_id int, connector string, kind string, text string, hint string, subjects array<string>").withColumn("occurred_at", F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00")))
    docs = serve.documents(pages, events)
    assert {r.doc_id: (r.title, r.sensitivity, r.taint) for r in docs.collect()} == {"page:1": ("Key", "public", "clean"), "page:2": ("Other", "private", "clean"), "event:7": ("chat msg", "unlabeled", "quoted")}
    hits = lambda *a, **k: ([r.doc_id for r in serve.search(docs, *a, **k)[0].collect()], serve.search(docs, *a, **k)[1])
    assert hits("hunter2", 3) == ([], [])  # the word is redacted, so the hit is not borne out
    assert hits("hunter", 0) == ([], []) and hits("hunter", 2) == (["page:2"], []) and hits("hunter", 3) == (["event:7", "page:2"], [])
    assert hits(" ", 3)[1] == ["query-empty"] and hits("x", 3, types=())[1] == ["scope-empty"] and hits("x", 3, degraded=("index-degraded",))[1] == ["index-degraded"]
    assert hits("hunter", 3, since="2024-01-01 00:00:00") == (["event:7"], ["canon-time-scope-unsupported"]) and hits("hunter", 3, until="2024-01-02 00:00:00", scope="ledger") == ([], [])
    assert hits("what is the zebra riding?", 3)[1] == ["query-relaxed", "query-no-match"] and hits("here", 3, subjects=("s",)) == (["page:1"], [])


def test_pages_entities_and_modes(spark):
    rows = spark.createDataFrame([("1", "a.md", "person", "Ann", "ann@x", ["A"], "Body. " * 20000, 0, False), ("2", "b.md", "person", "Bob", None, None, "b", 2, None), ("3", "c.md", "note", "Ann", None, None, "", 0, False), ("4", "d.md", "place", "Annex", None, None, "", None, False), ("5", "e.md", "project", "Zed", None, ["ANN"], "", 1, True)], "id string, path string, type string, title string, handle string, labels array<string>, body string, rank int, retracted boolean")
    page = lambda **k: [(r.id, r.reason, r.excerpt and len(r.excerpt), r.truncated) for r in serve.page(rows, 1, **k).collect()]
    assert page(id="1") == [("1", None, serve.BODY, True)] and page(path="b.md") == [("2", "above_ceiling", None, False)] and page(id="5") == page(id="9") == []
    with pytest.raises(ValueError):
        serve.page(rows, 1)
    served, withheld = serve.entities(rows, 1, name="ann")
    assert [r.id for r in served.collect()] == ["1"] and [(r.id, r.reason) for r in withheld.collect()] == [("4", "unlabeled")]
    with pytest.raises(ValueError):
        serve.entities(rows, 1, kind="note")
    of = serve.mode_labels
    assert (of("lexical", None, None, 0, 0), of("hybrid", None, "s", 1, 2), of("vector", "s", "t", 1, 0), of("hybrid", "s", "s", 3, 0), of("vector", "s", "s", 0, 0)) == (["keyword-zero"], ["vector-skipped"], ["embedding-space-mismatch"], ["vector-backlog", "keyword-zero"], [])


def test_archive_files(spark, tmp_path):
    (tmp_path / "tweets.js").write_text("window.YTD.tweets.part0 = " + json.dumps([{"tweet": {"id_str": "9", "created_at": "Wed Oct 10 20:19:24 +0000 2018", "full_text": "hi"}}, {"tweet": {"id": "10", "created_at": "never", "full_text": "x"}}]))
    got = [(r.record, str(r.at), r.text, r.reason) for r in X.post_archive(spark, f"{tmp_path}/tweets.js").orderBy("record").collect()]
    assert got == [("10", "None", "x", "time_invalid"), ("9", "2018-10-10 20:19:24", "hi", None)]
    (tmp_path / "m.json").write_text(json.dumps([{"slug": "s", "title": "T", "url": "http://x", "savedAt": "2024-01-01T00:00:00Z", "labels": ["l"]}, {"title": "no"}]))
    assert [(r.record, r.url, r.labels, r.reason) for r in X.reading_list(spark, f"{tmp_path}/m.json").collect()] == [("s", "http://x", ["l"], None), (None, None, [], "id_missing")]
    (tmp_path / "r.jsonl").write_text('{"id": "1", "kind": "k", "at": "2024-01-01T00:00:00Z", "text": "t"}\nbroken\n\n' + json.dumps({"id": "2", "at": "2024-01-01T00:00:00Z", "text": "x" * 70_000}) + "\n")
    assert [(r.line, r.record, r.reason) for r in X.runtime_records(spark, f"{tmp_path}/r.jsonl").orderBy("line").collect()] == [(0, "1", None), (1, None, "not_json"), (3, "2", "record_too_large")]
