"""Secret scans over an inverted index of trigrams, with DataFrame functions only.

From each rule's regular expression follows a Boolean query of trigrams that
every match must contain, case folded.  Postings of just these trigrams are
kept for blocks of documents, so no posting list grows with the corpus; within
a block the lists are intersected and united as the query says, and the
candidates are verified with the rule itself.  A rule without mandatory
trigrams (``hex``) scans all texts.

Spans are [start, end) in code points, leftmost and not overlapping for each
kind.  Null and empty texts have none; texts of any length are searched whole.
A document is known by a hash of its id and text, so rows that share an id and
rows without one spread, and rows that repeat both share candidates and are
verified each by itself.  Candidates meet the texts by ``hot_join``: while Spark
can broadcast them no text is shuffled, beyond that each text once.  Other
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import HOT_SHARE, hot_join, stored

_parser = re._parser  # the standard library's own parse tree of an expression


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is checked
    least: int = 1
    quick: str = ""  # for full scans: a cheaper expression that texts without a kept match fail


BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + ADDED
#: What follows a private key's header: all to its END line, or the lines of base64 and the key's own fields where END is
#: missing.  Neither crosses another header; the bounds keep the matcher's stack small.
_KEY = r"""(?:[^-]*+(?:-{1,4}+[^-]++){0,64}+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+(?:(?:Proc-Type|DEK-Info):[^\n]*+|[A-Za-z0-9+/=]{40,}+|[A-Za-z0-9+/=]++(?=[ \t\r]*+(?:\n|$)))){0,400}+)"""
#: For masking: the rules as they are, but a private key is one span from its header to its end.
WHOLE = tuple(replace(r, pattern=r.pattern + _KEY) if r.kind == "pem" else r for r in RULES)
#: Documents in a block of postings, on average.
BLOCK = 4096

Query = frozenset  # of frozensets of trigrams: any of these, all of each


def _either(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Query, b: Query) -> Query:
    return _either(frozenset(x | y for x in a for y in b), frozenset())


_ANY: Query = frozenset([frozenset()])


def _of_strings(strings: set[str]) -> Query:
    return reduce(_either, (frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings))


def _exact(item, most: int = 64) -> set[str] | None:
    """All case-folded strings that a part of an expression can match, if they are few."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
        return found if len(found := {chr(c).lower() for _, c in arg}) <= 4 else None
    if op == "SUBPATTERN":
        return _exact_all(arg[3])
    if op == "BRANCH":
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1):
        inner = _exact_all(arg[2])
        return None if inner is None else inner | {""}
    return None


def _exact_all(items) -> set[str] | None:
    found = {""}
    for item in items:
        part = _exact(item)
        if part is None or len(part) * len(found) > 64:
            return None
        found = {a + b for a in found for b in part}
    return found


def _needs(items) -> Query:
    need, run = _ANY, {""}
    for item in items:
        part = _exact(item)
        if part is not None and len(part) * len(run) <= 64:
            run = {a + b for a in run for b in part}
            continue
        need, run = _both(need, _of_strings(run)), {""}
        op, arg = str(item[0]), item[1]
        if op == "SUBPATTERN":
            need = _both(need, _needs(arg[3]))
        elif op == "BRANCH":
            need = _both(need, reduce(_either, map(_needs, arg[1])))
        elif op == "MAX_REPEAT" and arg[0] >= 1:
            need = _both(need, _needs(arg[2]))
    return _both(need, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Disjunction of conjunctions of lower-case trigrams that each match
    contains; one empty conjunction if the expression demands none."""
    return _needs(_parser.parse(pattern))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block: int = BLOCK) -> DataFrame:
    """(key, rules, w): documents that meet a rule's trigram query, the rules as
    bits, and the number of their rows.  ``docs``: key, text."""
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != _ANY}
    trigrams = sorted(set().union(*(t for q in asked.values() for t in q)))
    blocks = max(1, math.ceil(docs.count() / block))
    hits = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    held = docs.select("key", F.lower("text").alias("low")).select("key", F.explode(hits).alias("trigram")).groupBy("key", "trigram").agg(F.count(F.lit(1)).alias("n"))
    held = stored(held, "postings")
    postings = held.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_list("key").alias("keys"))
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("of"))
    none = F.array().cast("array<long>")

    def matched(query: Query) -> Column:
        every = [reduce(F.array_intersect, [F.coalesce(F.col("of")[t], none) for t in sorted(need)]) for need in sorted(query, key=sorted)]
        return reduce(F.array_union, every)

    def with_bit(keys: Column, bit: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(bit).alias("bit")))

    found = F.flatten(F.array(*(with_bit(matched(q), 1 << i) for i, q in asked.items())))
    met = index.select(F.explode(found).alias("x")).groupBy("x.key").agg(F.bit_or("x.bit").alias("rules"))
    return met.join(held.groupBy("key").agg(F.max("n").alias("w")), "key")


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind number, end, kind), by start."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.zip_with(F.transform(whole, F.length), F.transform(checked, F.length), lambda n, g: F.struct(n.alias("n"), g.alias("g")))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), lengths, lambda gap, x: F.struct(gap.alias("gap"), x["n"].alias("n"), x["g"].alias("g")))
    span = "struct<start:int,rank:int,end:int,kind:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["g"] >= rule.least, F.array_append(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, empty, step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``text``, the columns in ``carry``, and ``spans``: array of
    (start, rank, end, kind), ordered by start, then by the rules' order."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.select(F.struct(F.col(id_col), *carry).alias("row"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(candidates(base.select("key", "text"), rules, block), "candidates")
    bits = F.coalesce("rules", F.lit(0))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def verified(i: int, rule: Rule) -> Column:
        all_spans = rule_spans(F.col("text"), rule, i)
        if trigram_query(rule.pattern) == _ANY:
            return F.when(F.rlike("text", F.lit(rule.quick or rule.pattern)), all_spans).otherwise(none)
        return F.when(bits.bitwiseAND(1 << i) != 0, all_spans).otherwise(none)

    spans = F.array_sort(F.flatten(F.array(*(verified(i, r) for i, r in enumerate(rules)))))
    total = max(1, base.count())
    # hot rows that meet no trigram query have no partner to be joined with: they stay where they are
    heavy = base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE >= total).select("key")
    idle = F.broadcast(stored(heavy.join(found.select("key"), "key", "left_anti"), "idle"))
    alone = base.join(idle, "key", "left_semi").withColumn("rules", F.lit(None).cast(found.schema["rules"].dataType))
    met = hot_join(base.join(idle, "key", "left_anti"), found, "key", "w", total, "left").unionByName(alone)
    return met.select("row.*", "text", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each run of overlapping or touching spans replaced by ``mask``."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] > acc["at"]) | (acc["out"] == ""), more).otherwise(longer)

    return F.aggregate(spans, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the registered query."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(rules):
        p = quoted(r.pattern)
        parts.append(
            f"""SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda k: struct_pack(
  s := (list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::BIGINT,
  n := length(m[k])::BIGINT, g := length(c[k])::BIGINT))) AS x, {i} AS rank, {quoted(r.kind)} AS kind
 FROM (SELECT rid, string_split_regex(text, {p}) AS b, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {r.group}) AS c FROM docs WHERE regexp_matches(text, {p}))"""
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT rid, rank, kind, x.s AS s, x.s + x.n AS e FROM raw WHERE x.g >= CASE rank {least} END),
said AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
 coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
 coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS every FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM docs LEFT JOIN said USING (rid)"""
