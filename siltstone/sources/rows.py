"""Landed exports as ledger rows: one schema, whatever the source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "connector string, record string, kind string, occurred_at timestamp_ntz, text string, subjects array<struct<id:string,role:string>>, deleted boolean"


@dataclass(frozen=True)
class Mapping:
    """How rows of a table become ledger rows."""

    connector: str
    record: str
    kind: str | None = None  # a constant, or else ``kind_column`` with ``kinds``
    kind_column: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    occurred_at: str | None = None
    text: tuple[str, ...] = ()
    subjects: tuple[tuple[str, str], ...] = ()  # column, role
    deleted: str | None = None


def mapped(rows: DataFrame, m: Mapping) -> DataFrame:
    """SCHEMA and ``skip_reason``, null for rows that are accepted."""
    kind = F.lit(m.kind) if m.kind else F.create_map(*(F.lit(x) for kv in m.kinds.items() for x in kv))[F.col(m.kind_column)]
    record = F.col(m.record).cast("string")
    record = F.when(F.length(record) > 256, F.sha2(record.cast("binary"), 256)).otherwise(record)
    deleted = F.coalesce(F.col(m.deleted).cast("boolean"), F.lit(False)) if m.deleted else F.lit(False)
    at = F.col(m.occurred_at).cast("timestamp_ntz") if m.occurred_at else F.lit(None).cast("timestamp_ntz")
    text = F.concat_ws("\n", *(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in m.text))
    people = F.array(*(F.struct(F.concat(F.lit(f"{m.connector}:"), F.col(c).cast("string")).alias("id"), F.lit(r).alias("role")) for c, r in m.subjects))
    people = F.array_distinct(F.filter(people, lambda s: s["id"].isNotNull())) if m.subjects else F.array().cast("array<struct<id:string,role:string>>")
    reason = F.when(F.coalesce(record, F.lit("")) == "", "record_missing").when(kind.isNull(), "kind_unmapped")
    reason = reason.when(at.isNull(), "occurred_at_invalid") if m.occurred_at else reason
    return rows.select(
        F.lit(m.connector).alias("connector"), record.alias("record"), kind.alias("kind"), at.alias("occurred_at"),
        F.when(~deleted, text).alias("text"), people.alias("subjects"), deleted.alias("deleted"), reason.alias("skip_reason"),
    )


_BLANK = r"[ \x{A0}\x{202F}]"
_STAMP = rf"(\d{{1,4}})([/.-])(\d{{1,2}})\2(\d{{1,4}}),?{_BLANK}+(\d{{1,2}}):(\d\d)(?::(\d\d))?(?:{_BLANK}?([AaPp])\.?{_BLANK}?[Mm]\.?)?"
_HEAD = rf"^\[?{_STAMP}(?:\]{_BLANK}+|{_BLANK}*-{_BLANK}+)(.*)$"


def chat_text(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Chats' text exports: (file, n, at, sender, text, reason), a row a message.  Lines without a head go on the message
    before; heads without a sender are notices and left out.

    Dates say day or month first, or the year; which, a file's numbers above 12 tell, else the one order in which its
    days don't run backwards.  Where neither tells, or they contradict each other, ``order`` (dmy, mdy or ymd) does, and
    else the file's rows have no time and a reason.  The clock has 24 hours, or 12 with am or pm.  A file is cut into
    messages within its own row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    lines = files.select("file", F.transform(F.split(F.regexp_replace("value", r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"^[\x{200E}\x{200F}]+", "")).alias("lines"))
    head = lambda x: F.rlike(x, F.lit(_HEAD))
    # a message is its head and what follows; messages are found by the number of heads so far, kept as text with marks
    marked = F.array_join(F.transform("lines", lambda x: F.when(head(x), F.concat(F.lit("\x1e"), x)).otherwise(x)), "\n")
    messages = F.filter(F.split(marked, "\\x1e"), lambda x: F.rlike(x, F.lit(_HEAD.replace("(.*)$", ""))))
    g = lambda x, i: F.regexp_extract(x, _HEAD.replace("(.*)$", r"([^\n]*)"), i)
    whole = lambda x, i: g(x, i).try_cast("int")
    parsed = F.transform(messages, lambda x: F.struct(
        whole(x, 1).alias("a"), whole(x, 3).alias("b"), whole(x, 4).alias("c"), (F.length(g(x, 1)) == 4).alias("wide"), (F.length(g(x, 4)) == 4).alias("long"), whole(x, 5).alias("hour"), whole(x, 6).alias("minute"), F.coalesce(whole(x, 7), F.lit(0)).alias("second"),
        F.lower(g(x, 8)).alias("half"), F.regexp_replace(F.regexp_replace(x, _HEAD.replace("(.*)$", ""), ""), r"\n\z", "").alias("rest"),
    ))
    year = lambda m: F.when(m["long"] | (m["c"] >= 100), m["c"]).otherwise(2000 + m["c"])
    days = {"ymd": lambda m: (m["a"], m["b"], m["c"]), "dmy": lambda m: (year(m), m["b"], m["a"]), "mdy": lambda m: (year(m), m["a"], m["b"])}
    number = lambda of: F.transform("m", lambda x: of(x)[0] * 10000 + of(x)[1] * 100 + of(x)[2])
    forward = lambda of: F.array_sort(number(of)) == number(of)
    any_ = lambda f: F.exists("m", f)
    day_first, month_first = any_(lambda m: m["a"] > 12), any_(lambda m: m["b"] > 12)
    told = (
        F.when(any_(lambda m: m["wide"]), F.when(F.forall("m", lambda m: m["wide"]), "ymd")).when(day_first & month_first, F.lit(None)).when(day_first, "dmy").when(month_first, "mdy")
        .when(forward(days["dmy"]) & ~forward(days["mdy"]), "dmy").when(forward(days["mdy"]) & ~forward(days["dmy"]), "mdy")
    )
    found = lines.select("file", parsed.alias("m")).withColumn("order", F.coalesce(told, F.lit(order)) if order else told)
    rows = found.select("file", "order", F.posexplode("m").alias("n", "m"))
    hour = F.when(F.col("m.half") == "", F.when(F.col("m.hour") <= 23, F.col("m.hour"))).when(F.col("m.hour").between(1, 12), F.col("m.hour") % 12 + F.when(F.col("m.half") == "p", 12).otherwise(0))
    date = lambda of: F.concat_ws("-", F.lpad(of[0].cast("string"), 4, "0"), F.lpad(of[1].cast("string"), 2, "0"), F.lpad(of[2].cast("string"), 2, "0"))
    day = F.when(F.col("order") == "ymd", date(days["ymd"](F.col("m")))).when(F.col("order") == "dmy", date(days["dmy"](F.col("m")))).when(F.col("order") == "mdy", date(days["mdy"](F.col("m"))))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.try_to_timestamp(F.concat(day, F.lit(" "), two(hour), F.lit(":"), two(F.col("m.minute")), F.lit(":"), two(F.col("m.second"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    sender = F.regexp_extract("m.rest", r"^([^\n]*?): ", 1)
    text = F.regexp_replace("m.rest", r"^[^\n]*?: ", "")
    reason = F.when(F.col("order").isNull(), "date_order_unclear").when(at.isNull(), "time_invalid")
    said = rows.where(F.rlike("m.rest", F.lit(r"^[^\n]+?: ")))
    return said.select("file", (F.col("n") + 1).cast("long").alias("n"), at.alias("at"), sender.alias("sender"), text.alias("text"), reason.alias("reason"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: (path, title, front: map of the scalar fields, body)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    front = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    body = F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")
    pairs = F.filter(F.split(front, r"\r?\n"), lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][\w-]*:")))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1), F.trim(F.regexp_replace(x, r"^[^:]*:", ""), F.lit(" \"'")))))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return files.select("path", fields.alias("front"), body.alias("body")).withColumn("title", F.coalesce(F.try_element_at("front", F.lit("title")), name))


def bookmarks_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bookmark export with quoted, multi-line fields, as SCHEMA and skip_reason."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    rows = rows.withColumn("occurred", F.to_timestamp_ntz(F.timestamp_seconds(F.col("time_added").cast("long")).cast("string")))
    return mapped(rows, Mapping("bookmarks", "url", kind="bookmark", occurred_at="occurred", text=("title", "url")))


def _in_tree(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, conversation_id string, title string, current_node string, mapping map<string, struct<message:struct<id:string,author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>>>,parent:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("conversation", F.coalesce("id", "conversation_id"))
    return rows.select("conversation", "title", "current_node", F.explode(F.map_entries("mapping")).alias("e")).select("conversation", "title", "current_node", F.col("e.key").alias("node"), "e.value.*")


def tree_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations whose messages are a tree of nodes (``mapping``): conversation, title, node, parent, record, role, at,
    text, active (on the branch that ends in the current node), reason (null for messages that are taken)."""
    nodes = _in_tree(spark, path)
    # the branch in use is a path of parents, found within the conversation's own rows
    links = nodes.groupBy("conversation").agg(F.first("current_node").alias("current"), F.map_from_entries(F.collect_list(F.struct("node", "parent"))).alias("up"))
    step = lambda acc, _: F.struct(F.try_element_at(F.col("up"), acc["at"]).alias("at"), F.when(acc["at"].isNotNull(), F.array_append(acc["seen"], acc["at"])).otherwise(acc["seen"]).alias("seen"))
    start = F.struct(F.col("current").alias("at"), F.array().cast("array<string>").alias("seen"))
    branch = links.select("conversation", F.aggregate(F.sequence(F.lit(1), F.size("up")), start, step, lambda acc: acc["seen"]).alias("branch"))
    parts = F.filter("message.content.parts", lambda p: ~F.startswith(F.trim(p), F.lit("{")))
    text = F.array_join(parts, "\n")
    role = F.col("message.author.role")
    kind = F.col("message.content.content_type")
    reason = (
        F.when(role.isNull(), "malformed_author").when(~role.isin("user", "assistant", "system", "tool"), "unsupported_role").when(kind.isin("user_editable_context", "model_editable_context"), "instructions")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_content")
    )
    found = nodes.where("message IS NOT NULL").join(branch, "conversation")
    return found.select("conversation", "title", "node", "parent", F.coalesce("message.id", "node").alias("record"), role.alias("role"), F.timestamp_seconds("message.create_time").alias("at"), text.alias("text"), F.array_contains("branch", F.col("node")).alias("active"), reason.alias("reason"))


def list_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with a list of messages (``chat_messages``): conversation, title, turn, record, role, at, text, reason."""
    schema = "uuid string, name string, chat_messages array<struct<uuid:string,sender:string,created_at:string,text:string,content:array<struct<type:string,text:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("uuid").alias("conversation"), F.col("name").alias("title"), F.posexplode("chat_messages").alias("turn", "m"))
    blocks = F.array_join(F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.coalesce(F.nullif(F.trim("m.text"), F.lit("")), blocks, F.lit(""))
    at = F.try_to_timestamp("m.created_at")
    reason = F.when(~F.coalesce(F.col("m.sender").isin("human", "assistant"), F.lit(False)), "unsupported_sender").when(F.trim(text) == "", "empty_content").when(at.isNull(), "time_invalid")
    return rows.select("conversation", "title", "turn", F.col("m.uuid").alias("record"), F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"), at.alias("at"), text.alias("text"), reason.alias("reason"))


def session_logs(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> DataFrame:
    """Logs of agent sessions, a JSON object a line, in two dialects: file, line, session, record, role, at, text, reason.

    In one, a line is a user's or an assistant's message with its session's id; in the other a response item, and the
    file's first line names the session.  With ``offsets`` (file, lines: how many were read) only later lines are
    returned; ``max(line) + 1`` of a file is the next offset.  The last line without a line end is not complete and waits."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.slice(F.split("value", r"\r?\n"), F.lit(1), F.greatest(F.size(F.split("value", r"\r?\n")) - 1, F.lit(0)))
    rows = files.select("file", F.get(lines, F.lit(0)).alias("first"), F.posexplode(lines).alias("line", "value"))
    if offsets is not None:
        rows = rows.join(offsets.select("file", "lines"), "file", "left").where(F.col("line") >= F.coalesce("lines", F.lit(0))).drop("lines")
    of = lambda p: F.get_json_object("value", p)
    kind = of("$.type")
    item = kind == "response_item"
    turn = kind.isin("user", "assistant")
    content = F.when(item, of("$.payload.content")).otherwise(of("$.message.content"))
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    words = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")
    text = F.when(F.startswith(F.trim(content), F.lit("[")), words).otherwise(content)
    role = F.when(item, of("$.payload.role")).otherwise(kind)
    session = F.when(item, F.coalesce(F.get_json_object("first", "$.payload.id"), F.get_json_object("first", "$.id"))).otherwise(of("$.sessionId"))
    at = F.try_to_timestamp(of("$.timestamp"))
    reason = (
        F.when(F.get_json_object("value", "$").isNull() | ~F.startswith(F.trim("value"), F.lit("{")), "not_json").when(~F.coalesce(item | turn, F.lit(False)), "ignored_type")
        .when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), "ignored_role").when(session.isNull(), "session_missing").when(at.isNull(), "time_invalid").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_content")
    )
    record = F.coalesce(of("$.uuid"), of("$.payload.id"), F.concat_ws(":", session, F.col("line").cast("string")))
    return rows.select("file", "line", session.alias("session"), record.alias("record"), role.alias("role"), at.alias("at"), text.alias("text"), reason.alias("reason"))


def vanished(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Tombstones for records of the last listing that this one lacks."""
    return before.select(key).distinct().join(now.select(key).distinct(), key, "left_anti").withColumn("deleted", F.lit(True))


def recurrences(events: DataFrame, key: str, start: str, step_days: Column, count: Column, weekdays: Column | None = None) -> DataFrame:
    """Occurrences of events that repeat every so many days; ``count`` includes those that
    ``weekdays`` (1 Sunday to 7 Saturday) then keeps out."""
    days = F.sequence(F.lit(0), (count - 1) * step_days, step_days)
    rows = events.select(key, F.col(start).cast("date").alias("first"), F.posexplode(days).alias("n", "offset"), *([weekdays.alias("w")] if weekdays is not None else []))
    rows = rows.withColumn("day", F.date_add("first", F.col("offset")))
    rows = rows.where(F.array_contains("w", F.dayofweek("day"))) if weekdays is not None else rows
    return rows.select(key, F.col("n").cast("long").alias("n"), "day")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments first, then tags."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def post_archive(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a social archive's script files (an assignment of a JSON array): record, at, text, reply_to, reason."""
    kind = "array<struct<tweet:struct<id_str:string,id:string,created_at:string,full_text:string,in_reply_to_status_id_str:string>>>"
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)\A\s*[A-Za-z_.0-9]+\s*=\s*", "").alias("value"))
    rows = files.select(F.explode(F.from_json("value", kind)).alias("p")).select("p.tweet.*")
    at = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("created_at", r"^\w+ (\w+ \d+ [\d:]+)", 1), F.regexp_extract("created_at", r"(\d{4})$", 1), F.regexp_extract("created_at", r"([+-]\d{4})", 1)), F.lit("MMM dd HH:mm:ss yyyy Z"))
    record = F.coalesce("id_str", "id")
    reason = F.when(record.isNull(), "id_missing").when(at.isNull(), "time_invalid").when(F.trim(F.coalesce("full_text", F.lit(""))) == "", "empty_content")
    return rows.select(record.alias("record"), at.alias("at"), F.col("full_text").alias("text"), F.col("in_reply_to_status_id_str").alias("reply_to"), reason.alias("reason"))


def reading_list(spark: SparkSession, path: str) -> DataFrame:
    """Saved articles of an export's metadata files (JSON arrays): record, url, title, at, labels, reason."""
    schema = "id string, slug string, title string, url string, savedAt string, labels array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    at = F.try_to_timestamp("savedAt")
    reason = F.when(F.coalesce("slug", "id").isNull(), "id_missing").when(F.coalesce("url", F.lit("")) == "", "url_missing").when(at.isNull(), "time_invalid")
    return rows.select(F.coalesce("slug", "id").alias("record"), "url", "title", at.alias("at"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), reason.alias("reason"))


#: Bytes of a record and records of a file of a runtime's snapshot, at most (fixed values).
RECORD_BYTES, RECORDS = 65_536, 20_000


def runtime_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an agent runtime's snapshot, a JSON object a line: file, line, record, kind, at, text, reason."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where("trim(value) <> ''")
    of = lambda p: F.get_json_object("value", p)
    at = F.try_to_timestamp(F.coalesce(of("$.timestamp"), of("$.at")))
    reason = (
        F.when(F.octet_length("value") > RECORD_BYTES, "record_too_large").when(F.col("line") >= RECORDS, "too_many_records").when(of("$").isNull() | ~F.startswith(F.trim("value"), F.lit("{")), "not_json")
        .when(of("$.id").isNull(), "id_missing").when(at.isNull(), "time_invalid")
    )
    return files.select("file", "line", of("$.id").alias("record"), of("$.kind").alias("kind"), at.alias("at"), of("$.text").alias("text"), reason.alias("reason"))
