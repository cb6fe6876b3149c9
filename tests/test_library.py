import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import claims, graph, ledger, policy, reports, search, timeline
from siltstone.sources import rows as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, s, n",
    [
        ("1970-01-01T00:00:01Z", 1, 0), ("1970-01-01t00:00:00.5z", 0, 500_000_000), ("1970-01-02T00:00:00.123456789+23:59", 86_400 - 86_340, 123_456_789),
        ("1970-01-01T00:59:60Z", 3599, 999_999_999), ("1970-01-01T00:58:60Z", None, None), ("2026-02-30T00:00:00Z", None, None), ("nonsense", None, None),
    ],
)
def test_instant(spark, text, s, n):
    got = one(spark, S.instant(F.lit(text)))
    assert (got and (got["s"], got["n"])) == (None if s is None else (s, n))


def test_text_helpers(spark):
    assert one(spark, S.preview(F.lit("  a\n\n b\tc "))) == "a b c"
    assert one(spark, S.normalized_object(F.lit(" Hello   World!! "))) == "hello world"
    assert one(spark, S.slug(F.lit("Ärger: One, Two"))) == "rger-one-two"
    assert "[redacted:url_credentials]" in one(spark, S.redacted(F.lit("see https://me:pw@host/x")))
    assert one(spark, S.is_credential(F.lit('token = "abcdefgh1234"')))
    assert one(spark, S.jaccard(S.trigrams(F.lit("word")), S.trigrams(F.lit("word")))) == 1.0


def test_live_allows_recapture(spark):
    df = spark.createDataFrame([(1, 1, "r", False), (2, 2, "r", True), (3, 3, "r", False), (4, 1, "q", False)], "event_id long, accepted_at long, record string, deleted boolean")
    assert {r.event_id for r in ledger.live(df, "record").collect()} == {3, 4}


def test_scope_comes_before_versions(spark):
    df = spark.createDataFrame([(1, 1, "r", 0), (2, 2, "r", 2)], "event_id long, accepted_at long, record string, sensitivity int")
    seen = ledger.current(df.where(policy.within_ceiling(F.col("sensitivity"), 1)), "record")
    assert [r.event_id for r in seen.collect()] == [1]  # the hidden version masks nothing


def test_policy_arguments():
    with pytest.raises(ValueError):
        policy.Grant(3)
    with pytest.raises(ValueError):
        timeline.day_window(None, "2026-02-30")


def test_query_grammar():
    assert search.parse_query('alpha "two words" AND pre* "say ""hi""" --') == [("alpha", False), ("two words", False), ("pre", True), ("say hi", False)]
    assert search.relaxed_terms("Where did we decide on the licenses?") == ([("decid*", "decision*"), ("licens*",)], 2)
    assert search.relaxed_terms("what did we decide") == ([("decid*", "decision*")], 1)
    assert search.relaxed_terms("launch plans status") == ([], 0)  # no question
    assert search.relaxed_terms('where is "the plan" kept?') == ([], 0) and search.relaxed_terms("who are they?") == ([], 0)
    assert search.relaxed_terms("why " + " ".join(f"word{i}x" for i in range(13)) + "?") == ([], 0)  # too long to relax
    assert search.relaxed_terms("how was the boat named used?")[0] == [("boat*",), ("named*",), ("used*",)]


def test_spans_and_ranking(spark):
    assert one(spark, search.spans(F.lit("the the THE, them. the"), "the")) == 4
    assert one(spark, search.spans(F.lit("an and ant-an"), "an", True)) == 4 and one(spark, search.spans(F.lit("a b a  b ab"), "a b")) == 2
    rows = [(1, "Launch plan", "the launch plan for may", False), (2, "Notes", "launch launch launch launch plan " * 40, False), (3, "Digest", "launch plan", True), (4, "Digest", "launch plan", False), (5, "x", "plan", False)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, machine boolean")
    found = [r.doc_id for r in search.literal(docs, "launch plan", "title", "text", "doc_id", 10, F.col("machine")).collect()]
    assert found[0] == 1 and found.index(4) < found.index(3) and set(found) == {1, 2, 3, 4}
    assert not search.literal(docs, " -- ", "title", "text", "doc_id", 10).count()
    hits, labels = search.search(docs, "where is the launched plans?", "title", "text", "doc_id")
    assert labels == ["query-relaxed"] and {r.doc_id for r in hits.collect()} == {1, 2, 3, 4}
    assert search.search(docs, "--", "title", "text", "doc_id")[1] == ["query-empty"]
    assert search.search(docs, "what is zebra gossip?", "title", "text", "doc_id")[1] == ["query-relaxed", "query-no-match"]
    assert one(spark, search.snippet(F.lit("x" * 100 + " needle " + "y" * 200), ["needle"])) == "…" + "x" * 39 + " needle " + "y" * 73 + "…"
    assert one(spark, search.snippet(F.lit("short"), [])) == "short"


def test_resolution_matrix(spark):
    """Tiers: 1 model, 2 connector, 3 owner, 4 correction."""

    def settle(live, incoming, purged=False):
        cols = "claim_id long, tier int, confidence double, valid_from string"
        a, b = (spark.createDataFrame([(i, *x)], cols).alias(n) for i, n, x in ((1, "a", live), (2, "b", incoming)))
        r = a.crossJoin(b).select(claims.resolution(F.lit(purged)).alias("r")).first().r
        return r.rule, r.action, r.winner

    day = "2026-01-0{}".format
    assert settle((4, 0.9, day(1)), (1, 0.1, day(1)), True) == ("R6", "supersede", "incoming")
    assert settle((3, 0.9, day(1)), (4, 0.1, day(1))) == ("R5", "supersede", "incoming")
    assert settle((4, 0.9, day(1)), (3, 0.9, day(2))) == ("R1", "skip", None)
    assert settle((4, 0.9, day(1)), (4, 0.2, day(2))) == ("R3", "supersede", "incoming") and settle((4, 0.9, day(2)), (4, 0.9, day(1))) == ("R3", "supersede", "live")
    assert settle((2, 0.1, day(1)), (1, 0.9, day(2))) == ("R2", "skip", None)
    assert settle((2, 0.9, day(1)), (3, 0.1, day(1))) == ("R1", "supersede", "incoming") and settle((3, 0.1, day(1)), (2, 0.9, day(2))) == ("R1", "skip", None)
    assert settle((2, 0.9, day(1)), (2, 0.2, day(2))) == ("R4", "contested", None)  # later, but much less sure
    assert settle((2, 0.5, day(1)), (2, 0.64, day(2))) == ("R4", "contested", None) and settle((2, 0.5, day(1)), (2, 0.65, day(2))) == ("R3", "supersede", "incoming")
    assert settle((1, 0.9, day(2)), (1, 0.5, day(1))) == ("R3", "supersede", "live") and settle((3, 0.9, day(1)), (3, 0.2, day(2))) == ("R3", "supersede", "incoming")
    assert settle((3, 0.5, day(1)), (3, 0.5, day(1))) == ("R3", "supersede", "incoming")  # the larger id


def test_deny_fails_closed(spark):
    grant = policy.Grant(1, ("note",), ("credential",), ("me",), "2026-01-01 00:00:00", "2026-01-31 00:00:00")
    rows = [
        (0, "note", ["me"], "2026-01-10 00:00:00", False, None), (None, "note", ["me"], "2026-01-10 00:00:00", False, "missing_sensitivity"), (7, "note", ["me"], "2026-01-10 00:00:00", False, "missing_sensitivity"),
        (2, "note", ["me"], "2026-01-10 00:00:00", False, "above_ceiling"), (0, None, ["me"], "2026-01-10 00:00:00", False, "type_out_of_scope"), (0, "note", None, "2026-01-10 00:00:00", False, "subject_out_of_scope"),
        (0, "note", [None], "2026-01-10 00:00:00", False, "subject_out_of_scope"), (0, "note", ["you", "me"], None, False, "time_out_of_scope"), (0, "note", ["me"], "2026-02-01 00:00:00", False, "time_out_of_scope"), (0, "note", ["me"], "2026-01-10 00:00:00", True, "held"),
    ]
    df = spark.createDataFrame(rows, "s int, k string, subjects array<string>, at string, held boolean, want string").withColumn("at", F.to_timestamp_ntz("at"))
    got = df.select("want", policy.deny_reason(grant, F.col("s"), F.col("k"), F.array(F.lit("x")), F.col("subjects"), F.col("at"), F.col("held")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert one(spark, policy.deny_reason(grant, F.lit(0), F.lit("note"), F.array(F.lit("credential")), F.array(F.lit("me")), F.to_timestamp_ntz(F.lit("2026-01-10 00:00:00")))) == "class_denied"


def test_instants_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, S.instant(F.lit("2026-03-08T02:30:00Z")))["s"] == 1772937000  # no such wall time there
        assert one(spark, S.micros(F.lit("1970-01-01 00:00:01.5").cast("timestamp_ntz"))) == 1_500_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_prefilter_and_paths(spark):
    why = lambda k, t: one(spark, policy.prefilter_reason(F.lit(k), F.lit(t)))
    assert [why("service", "hello there people"), why("note", " \n"), why("note", "!!! 👍"), why("note", "short one"), why("note", "long enough text"), why("note", "日本語")] == ["service", "empty", "no_words", "too_short", None, None]
    got = one(spark, policy.path_classes(F.array(F.lit("home/me/.ssh/id_rsa"), F.lit("notes/a.md")), {"**/.ssh/*": "credential", "*.md": "top", "notes/?.md": "note"}))
    assert got == ["credential", "note"]
    assert policy.any_of("a", ("b", "a")) == ("a", "b")
    assert one(spark, policy.source_policy(F.lit("email")))["floor"] == 1 and one(spark, policy.source_policy(F.lit("other")))["default"] == 2


def test_hybrid_recipe(spark):
    """Fusion, re-score, boost, dedup and collapse on the cases that fix their numbers."""
    lexical = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    vector = spark.createDataFrame([("b", 1, 0.0), ("a", 2, 1.0)], "id string, rank int, similarity double")
    both = {r.id: r for r in search.fused([lexical, vector], "id", carry=("similarity",)).collect()}
    assert both["a"].fused == both["b"].fused == 1.0 and both["a"].similarity == 1.0
    rows = spark.createDataFrame([("x", 2.0, 1.0), ("y", 2.0, None), ("z", 2.0, 0.0)], "id string, fused double, similarity double")
    assert {r.id: round(r.score, 9) for r in search.rescored(rows, "fused", "similarity").collect()} == {"x": 1.0, "y": 0.7, "z": 0.7}
    heavy = {r.id: r.fused for r in search.weighted(rows.withColumn("tier", F.when(F.col("id") == "x", 4)), F.col("tier")).collect()}
    assert heavy == {"x": 4.0, "y": 2.0, "z": 2.0}
    twice = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("b", 0.8)], "id string, score double")
    edge = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert max(r.score for r in search.adjacency_boost(twice, edge, "id", "score").collect()) == 1.0
    three = twice.unionByName(spark.createDataFrame([("c", 0.7)], "id string, score double"))
    raised = search.adjacency_boost(three, edge.unionByName(spark.createDataFrame([("c", "a")], "src string, dst string")), "id", "score", factor=2.0)
    assert {(r.id, r.score) for r in raised.collect()} == {("a", 2.0), ("b", 0.9), ("b", 0.8), ("c", 0.7)}
    cols = "id string, chunk int, kind string, text string, score double, corrected boolean"
    memo = spark.createDataFrame([("memo", 0, "page", "weekly report alpha beta gamma", 2.0, False), ("memo", 1, "page", "weekly report alpha beta gamma", 1.5, False), ("other", 0, "claim", "weekly report alpha beta gamma", 1.4, False)], cols)
    assert sorted((r.id, r.chunk) for r in search.layered(memo).collect()) == [("memo", 0), ("other", 0)]
    five = spark.createDataFrame([("one", 0, "claim", "one", 5.0, False), ("two", 0, "claim", "two", 4.0, False), ("three", 0, "claim", "three", 3.0, False), ("memo", 0, "page", "memo", 2.0, False), ("fixed", 0, "claim", "fixed", 1.0, True)], cols)
    assert {r.id for r in search.layered(five).collect()} == {"one", "two", "three", "memo", "fixed"}
    assert {r.id: r.score for r in search.collapsed(memo, "id", "score", "chunk").collect()} == {"memo": 2.0, "other": 1.4}


def test_wikilinks(spark):
    assert one(spark, graph.wikilinks(F.lit("see [[A|x]] and `[[B]]` and [[ C ]] [[A]]"))) == ["A", "C"]


def test_gap_and_packing(spark):
    c = spark.sql("SELECT * FROM VALUES (1, 'k', timestamp_ntz'2020-01-01', timestamp_ntz'2020-01-10'), (2, 'k', timestamp_ntz'2020-01-05', timestamp_ntz'2020-01-07'), (3, 'k', timestamp_ntz'2020-01-20', null) AS t(claim_id, claim_key, valid_from, valid_to)")
    g = claims.gaps(c).collect()
    assert [(str(r.gap_from)[:10], str(r.gap_to)[:10]) for r in g] == [("2020-01-10", "2020-01-20")]
    p = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 9, 4, 1])], "g long, i long, cost long")
    assert sorted(r.i for r in reports.packed(p, "g", ["i"], "cost", 10).collect()) == [0, 2, 3]  # 9 is skipped, smaller ones follow


def test_sources(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("25/12/2020, 10:00 - Ann: hi\nthere\n26/12/2020, 11:30 - Bob: yo: ok\n")
    got = X.chat_text(spark, str(tmp_path / "chat.txt")).orderBy("n").collect()
    assert [(r.sender, r.text, str(r.at)) for r in got] == [("Ann", "hi\nthere", "2020-12-25 10:00:00"), ("Bob", "yo: ok", "2020-12-26 11:30:00")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "Page.md").write_text("---\ntitle: 'The Page'\ntype: note\n---\nBody [[X]]\n")
    md = X.markdown(spark, str(tmp_path / "n")).first()
    assert (md.title, md.front["type"], md.body.strip()) == ("The Page", "note", "Body [[X]]")
    (tmp_path / "b.csv").write_text('title,url,time_added\n"A, ""b""",http://x,1600000000\n')
    row = X.bookmarks_csv(spark, str(tmp_path / "b.csv")).first()
    assert (row.record, row.text, row.skip_reason, str(row.occurred_at)) == ("http://x", 'A, "b"\nhttp://x', None, "2020-09-13 12:26:40")


def test_streaming_accepts_once(spark, tmp_path):
    from siltstone.streaming.ingest import arrivals, ingest

    df = spark.range(10).withColumn("v", F.lit("x"))
    for k in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        ingest(arrivals(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "ledger"), str(tmp_path / "cp"), "id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 10
