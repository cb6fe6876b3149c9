"""Cover density, requirement walks, kept views, line diffs, and files in their real layouts."""

import datetime as dt
import difflib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import lines
from siltstone.operators import inverted as V
from siltstone.operators import lexical, requires, views
from siltstone.sources import calendar
from siltstone.sources import recurrence as RR
from siltstone.sources import rows as X


def plain_density(hits, n):
    """Every stretch that holds all terms and none shorter inside it."""
    hits = sorted(hits)
    total = 0.0
    spans = [(i, j) for i in range(len(hits)) for j in range(i, len(hits)) if len({t for _, t, _ in hits[i : j + 1]}) == n]
    for i, j in spans:
        if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans):
            inv = sum(1 / w for *_, w in hits[i : j + 1])
            total += (j - i + 1) / inv / (1 + max(hits[j][0] - hits[i][0] - (j - i), 0))
    return total if spans else None


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cover_density(spark, n):
    rng = random.Random(n)
    rows = []
    for doc in range(30):
        places = sorted(rng.sample(range(60), rng.randint(1, 14)))
        rows += [(doc, rng.randrange(n), p, 1.0 if p < 8 else 0.1) for p in places]
    got = {r.doc: r.density for r in lexical.cover_density(spark.createDataFrame(rows, "doc long, term int, at int, weight double"), n).collect()}
    want = {d: v for d in range(30) if (v := plain_density([(p, t, w) for d2, t, p, w in rows if d2 == d], n)) is not None}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-12 for d in want)


def test_lexical_takes_like_titles_and_orders(spark, tmp_path):
    docs = [(1, "Permit office", "red fish and blue fish"), (2, "Red fish", "nothing here"), (3, "Other", "red herring then a fish"), (4, "red fishes", "none"), (5, "zzz", "fish alone")]
    index = V.Index(str(tmp_path / "i"))
    V.apply(index, spark.createDataFrame([(d, 0, t, b, False, False) for d, t, b in docs], "doc long, version int, title string, body string, machine boolean, deleted boolean"), "a")
    titles = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc long, title string")
    got = [r.doc for r in lexical.search(spark, index, titles, "red fish").collect()]
    assert got[0] == 2 and set(got) == {1, 2, 3, 4} and len(lexical.search(spark, index, titles, " ").collect()) == 5


FACT = "claim_id string, dependent string, required string, polarity string, events array<string>"


def facts(spark, *edges, polarity="positive"):
    return spark.createDataFrame([(f"c{i}", d, r, polarity, [f"e{i}"]) for i, (d, r) in enumerate(edges)], FACT)


def test_requires_walk(spark):
    f = facts(spark, ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("b", "a"), ("x", "y"))
    got = requires.impact(f, "a")
    assert got.current == [("b", 1, ["c0", "c5"]), ("c", 1, ["c1"]), ("d", 2, ["c0", "c5", "c2"])] and got.cycle == ["a", "b", "d", "a"] and not got.truncated and got.withdrawn == []
    assert requires.impact(f, "a", depth=1) == ([("b", 1, ["c0", "c5"]), ("c", 1, ["c1"])], [], True, None)
    assert requires.impact(f, "a", nodes=1) == ([("b", 1, ["c0", "c5"])], [], True, None)
    assert requires.impact(f, "nowhere") == ([], [], False, None)
    both = f.unionByName(facts(spark, ("z", "a"), ("w", "z"), polarity="negative").withColumn("claim_id", F.concat(F.lit("n"), "claim_id")))
    assert requires.impact(both, "a").withdrawn == [("z", 1, ["nc0"]), ("w", 2, ["nc0", "nc1"])]
    wide = facts(spark, *((f"n{i:03}", "a") for i in range(90)))
    assert [n for n, *_ in requires.impact(wide, "a").current] == [f"n{i:03}" for i in range(32)] and requires.impact(wide, "a").truncated


def test_requires_walk_refuses(spark):
    f = facts(spark, ("b", "a"), ("c", "b"))
    negative = lambda *e: facts(spark, *e, polarity="negative").withColumn("claim_id", F.concat(F.lit("n"), "claim_id"))
    for bad, code in (
        (f.unionByName(f), "ambiguous"), (f.unionByName(negative(("b", "a"))), "ambiguous"), (f.unionByName(negative(("c", "a"))), "ambiguous"), (f.withColumn("polarity", F.lit("maybe")), "unsupported"),
        (f.withColumn("events", F.array().cast("array<string>")), "unsupported"), (f.withColumn("required", F.lit(None).cast("string")), "unsupported"),
    ):
        with pytest.raises(requires.Refused) as e:
            requires.impact(bad, "a")
        assert e.value.code == code
    with pytest.raises(requires.Refused):
        requires.impact(f, "a", nodes=33)


def test_view_renews_what_changed(spark):
    rows = spark.createDataFrame([(i, f"g{i % 10}", i * 3) for i in range(200)], "i int, g string, v int").repartition(5)
    read = []

    def compute(of):
        out = of.groupBy("g").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
        read.append(of)
        return out

    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    view = views.built(rows, "g", ("i", "v"), compute, F.when(F.col("g") == "g7", at("2024-01-01 00:00:00")))
    changed = rows.withColumn("v", F.when(F.col("i") == 33, 0).otherwise(F.col("v"))).where("g <> 'g4'").unionByName(spark.createDataFrame([(900, "new", 1)], "i int, g string, v int"))
    got = {r.g: r for r in views.refreshed(view, changed, "g", ("i", "v"), compute, at("2024-06-01 00:00:00")).collect()}
    assert {g for g, r in got.items() if r.renewed} == {"g3", "g7", "new"} and "g4" not in got
    assert {r.g for r in read[-1].select("g").distinct().collect()} == {"g3", "g7", "new"}
    full = {r.g: (r.total, r.n, r.basis) for r in views.built(changed, "g", ("i", "v"), compute).collect()}
    assert {g: (r.total, r.n, r.basis) for g, r in got.items()} == full
    same = views.refreshed(view, rows.repartition(3), "g", ("i", "v"), compute, at("2023-06-01 00:00:00"))
    assert same.where("renewed").count() == 0 and same.count() == 10


def plain_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(reversed(range(len(a))), reversed(range(len(b)))):
        best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_line_diff(spark):
    assert lines.diff("a\nb\nc", "a\nx\nc\nd") == [("same", "a"), ("del", "b"), ("add", "x"), ("same", "c"), ("add", "d")]
    assert lines.diff("", "") == [] and lines.diff("", "a\n") == [("add", "a"), ("add", "")] and lines.diff("a\nb", "b\nc", cells=3) == [("del", "a"), ("del", "b"), ("add", "b"), ("add", "c")]
    rng = random.Random(1)
    pairs = [(i, "\n".join(rng.choices("abcd", k=rng.randint(1, 12))), "\n".join(rng.choices("abcd", k=rng.randint(1, 12)))) for i in range(60)] + [(60, None, "x"), (61, None, None)]
    got = {}
    for r in lines.line_diffs(spark.createDataFrame(pairs, "k int, a string, b string"), "k", "a", "b").orderBy("k", "n").collect():
        got.setdefault(r.k, []).append((r.op, r.line))
    assert 61 not in got and got[60] == [("add", "x")]
    for k, a, b in pairs[:60]:
        a, b = a.split("\n"), b.split("\n")
        ops = got[k]
        assert [x for op, x in ops if op != "add"] == a and [x for op, x in ops if op != "del"] == b
        assert sum(op == "same" for op, _ in ops) == plain_common(a, b)
    long = "\n".join(map(str, range(300)))
    edited = long.replace("\n150\n", "\n").replace("\n20\n", "\ntwenty\n")
    unit = [x for x in difflib.unified_diff(long.split("\n"), edited.split("\n"), n=0) if x[0] in "+-" and x[:3] not in ("---", "+++")]
    assert sorted(("add" if x[0] == "+" else "del", x[1:]) for x in unit) == sorted(d for d in lines.diff(long, edited) if d[0] != "same")


ICS = """BEGIN:VCALENDAR\r
VERSION:2.0\r
BEGIN:VTIMEZONE\r
TZID:Europe/Paris\r
BEGIN:STANDARD\r
DTSTART:19701025T030000\r
END:STANDARD\r
END:VTIMEZONE\r
BEGIN:VEVENT\r
UID:one\r
DTSTART;TZID=Europe/Paris:20240101T090000\r
DTEND;TZID=Europe/Paris:20240101T100000\r
SUMMARY:Stand\\, up with a long name that\r
  goes on\r
DESCRIPTION:a\\nb\\\\c\r
RRULE:FREQ=DAILY;COUNT=5;\r
EXDATE;TZID=Europe/Paris:20240103T090000\r
BEGIN:VALARM\r
DTSTART:20000101T000000\r
SUMMARY:alarm\r
END:VALARM\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:one\r
RECURRENCE-ID;TZID=Europe/Paris:20240102T090000\r
DTSTART;TZID=Europe/Paris:20240102T150000\r
SUMMARY:Moved\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:one\r
RECURRENCE-ID:20240104T090000\r
DTSTART:20240104T090000\r
STATUS:CANCELLED\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:two\r
DTSTART;VALUE=DATE:20240229\r
SUMMARY:Leap\r
END:VEVENT\r
BEGIN:VEVENT\r
SUMMARY:no uid\r
DTSTART:20240101\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:bad\r
DTSTART:soon\r
END:VEVENT\r
END:VCALENDAR\r
"""


def test_calendar_files(spark, tmp_path):
    (tmp_path / "a.ics").write_bytes(ICS.encode())
    (tmp_path / "empty.ics").write_text("")
    found = calendar.events(spark, f"{tmp_path}/*.ics")
    rows = found.orderBy("n").collect()
    assert [(r.uid, r.reason) for r in rows] == [("one", None), ("one", None), ("one", None), ("two", None), (None, "uid_missing"), ("bad", "start_invalid")]
    one = rows[0]
    assert (one.summary, one.description, one.zone, str(one.start), str(one.ends), one.all_day) == ("Stand, up with a long name that goes on", "a\nb\\c", "EUROPE/PARIS", "2024-01-01 09:00:00", "2024-01-01 10:00:00", False)
    days = [(r.uid, str(r.day), str(r.start), r.summary) for r in calendar.occurrences(found, F.lit("2024-12-31")).orderBy("uid", "day").collect()]
    assert days == [("one", "2024-01-01", "2024-01-01 09:00:00", one.summary), ("one", "2024-01-02", "2024-01-02 15:00:00", "Moved"), ("one", "2024-01-05", "2024-01-05 09:00:00", one.summary), ("two", "2024-02-29", "2024-02-29 00:00:00", "Leap")]


def test_rules_beyond_their_numbers(spark):
    cases = [("FREQ=YEARLY;BYMONTH=13", 1), ("FREQ=MONTHLY;BYMONTHDAY=40", 1), ("FREQ=MONTHLY;BYMONTHDAY=0", 1), ("FREQ=YEARLY;BYMONTH=-1", 1), ("FREQ=DAILY;COUNT=2;", 2), ("FREQ=DAILY;COUNT=3;nonsense", 3), ("FREQ=DAILY;UNTIL=20240103", 3), ("FREQ=DAILY;UNTIL=20240103T120000Z", 3), ("FREQ=DAILY;UNTIL=20240103T120000", 1), ("FREQ=DAILY;UNTIL=20240103 or so", 1), ("FREQ=MONTHLY;BYMONTHDAY=-31;COUNT=2", 2)]
    rows = spark.createDataFrame([(i, dt.date(2024, 1, 1), r) for i, (r, _) in enumerate(cases)], "i int, start date, rule string")
    got = [r.i for r in RR.expanded(rows, "i", "start", "rule", F.lit("2024-12-31")).collect()]
    assert [got.count(i) for i in range(len(cases))] == [n for _, n in cases]


def test_chat_exports(spark, tmp_path):
    cases = {
        "day.txt": "25/12/2020, 10:00 - Ann: hi\nthere\n26/12/2020, 11:30 - Bob: yo: ok\n",
        "half.txt": "‎[1/13/24, 12:05:09 AM] Ann: midnight\n[1/13/24, 1:00:00 p.m.] Messages are secret\n[1/14/24, 12:00:00 PM] Bob: noon\n",
        "year.txt": "2024-03-01, 23:59 - Ann: a\r\n2024-03-02, 0:00 - Bob: b\r\n",
        "runs.txt": "05.04.21, 8:00 - Ann: april\n01.05.21, 8:00 - Ann: may\n",
        "unclear.txt": "03/03/21, 8:00 - Ann: march\n",
        "wrong.txt": "25/01/21, 13:00 PM - Ann: x\n26/01/21, 9:61 - Ann: y\n",
        "none.txt": "no head here\n",
    }
    for name, text in cases.items():
        (tmp_path / name).write_text(text, newline="")
    got = {}
    for r in X.chat_text(spark, f"{tmp_path}/*.txt").orderBy("file", "n").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.sender, r.text, r.at and str(r.at), r.reason))
    assert got["day.txt"] == [("Ann", "hi\nthere", "2020-12-25 10:00:00", None), ("Bob", "yo: ok", "2020-12-26 11:30:00", None)]
    assert got["half.txt"] == [("Ann", "midnight", "2024-01-13 00:05:09", None), ("Bob", "noon", "2024-01-14 12:00:00", None)]
    assert got["year.txt"] == [("Ann", "a", "2024-03-01 23:59:00", None), ("Bob", "b", "2024-03-02 00:00:00", None)]
    assert [at for *_, at, _ in got["runs.txt"]] == ["2021-04-05 08:00:00", "2021-05-01 08:00:00"]
    assert got["unclear.txt"] == [("Ann", "march", None, "date_order_unclear")] and [r for *_, r in got["wrong.txt"]] == ["time_invalid"] * 2 and "none.txt" not in got
    assert str(X.chat_text(spark, f"{tmp_path}/unclear.txt", order="mdy").first().at) == "2021-03-03 08:00:00"


def test_conversation_exports(spark, tmp_path):
    say = lambda role, kind, *parts: {"id": None, "author": {"role": role}, "create_time": 1.5, "content": {"content_type": kind, "parts": list(parts)}}
    tree = {"r": {"message": None, "parent": None}, "a": {"message": say("user", "text", "hi"), "parent": "r"}, "b": {"message": say("assistant", "text", "yes", {"asset_pointer": "x"}, "more"), "parent": "a"}, "b2": {"message": say("assistant", "text", "no"), "parent": "a"}, "s": {"message": say("user", "user_editable_context", "be kind"), "parent": "r"}, "e": {"message": say("tool", "text", " "), "parent": "b"}, "w": {"message": say("robot", "text", "x"), "parent": "b"}}
    (tmp_path / "g.json").write_text(json.dumps([{"conversation_id": "c1", "title": "T", "current_node": "b", "mapping": tree}, {"id": "c2", "title": "U", "mapping": {}}]))
    got = {r.node: r for r in X.tree_conversations(spark, f"{tmp_path}/g.json").collect()}
    assert {n: (r.role, r.text, r.active, r.reason) for n, r in got.items() if r.reason is None} == {"a": ("user", "hi", True, None), "b": ("assistant", "yes\nmore", True, None), "b2": ("assistant", "no", False, None)}
    assert {n: r.reason for n, r in got.items() if r.reason} == {"s": "instructions", "e": "empty_content", "w": "unsupported_role"} and got["a"].conversation == "c1"
    (tmp_path / "c.json").write_text(json.dumps([{"uuid": "c", "name": "N", "chat_messages": [{"uuid": "m", "sender": "human", "created_at": "2026-01-01T09:00:01Z", "text": "q"}, {"uuid": "n", "sender": "assistant", "created_at": "2026-01-01T09:00:02Z", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}, {"uuid": "o", "sender": "bot", "created_at": "2026-01-01T09:00:02Z", "text": "x"}, {"uuid": "p", "sender": "human", "created_at": "soon", "text": "x"}]}]))
    assert [(r.record, r.role, r.text, r.reason) for r in X.list_conversations(spark, f"{tmp_path}/c.json").orderBy("turn").collect()] == [("m", "user", "q", None), ("n", "assistant", "a\nb", None), ("o", "bot", "x", "unsupported_sender"), ("p", "user", "x", "time_invalid")]


def test_session_logs_in_two_dialects_from_an_offset(spark, tmp_path):
    one = [{"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}, {"type": "summary"}, {"type": "assistant", "uuid": "u2", "sessionId": "s", "timestamp": "2026-01-01T00:00:01Z", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "t"}, {"type": "text", "text": "b"}]}}]
    two = [{"type": "session_meta", "payload": {"id": "z"}}, {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "q"}]}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, one)) + "\nnot json\n" + '{"type": "user"')
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, two)) + "\n")
    found = X.session_logs(spark, f"{tmp_path}/*.jsonl")
    got = [(r.file[-7], r.line, r.session, r.record, r.role, r.text, r.reason) for r in found.orderBy("file", "line").collect()]
    assert [g for g in got if g[-1] is None] == [("a", 0, "s", "u1", "user", "hello", None), ("a", 2, "s", "u2", "assistant", "a\nb", None), ("b", 1, "z", "z:1", "user", "q", None)]
    assert [g[-1] for g in got if g[-1]] == ["ignored_type", "not_json", "ignored_type", "ignored_role"]
    offsets = found.groupBy("file").agg((F.max("line") + 1).alias("lines"))
    assert X.session_logs(spark, f"{tmp_path}/*.jsonl", offsets).count() == 0
    done = spark.createDataFrame([(r.file, 2) for r in offsets.collect() if "a.jsonl" in r.file], "file string, lines int")
    assert sorted((r.file[-7], r.line) for r in X.session_logs(spark, f"{tmp_path}/*.jsonl", done).collect()) == [("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]
