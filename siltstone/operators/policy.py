"""Authorization as predicates that stand below every window, rank and limit."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalar import micros


@dataclass(frozen=True)
class Grant:
    ceiling: int
    kinds: tuple[str, ...] = ()
    denied_classes: tuple[str, ...] = ("credential",)
    subjects: tuple[int, ...] = ()
    since: str | None = None
    until: str | None = None  # inclusive, unlike a query's
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.ceiling not in (0, 1, 2):
            raise ValueError("a ceiling is 0, 1 or 2")


def within_ceiling(sensitivity: Column, ceiling: int) -> Column:
    """Labels outside the lattice are null and never pass."""
    return F.when(sensitivity.between(0, 2), sensitivity) <= ceiling


def deny_reason(grant: Grant, sensitivity: Column, kind: Column, classes: Column, subjects: Column, at: Column, held: Column | None = None) -> Column:
    """The first check that fails, in a fixed order; null means served.  What a check needs and does not find fails it.
    ``subjects`` and ``classes`` are arrays; a null array of classes has none."""
    fails = lambda c: F.coalesce(~c, F.lit(True))
    reason = F.when(F.coalesce(held, F.lit(False)) if held is not None else F.lit(False), "held")
    reason = reason.when(fails(sensitivity.between(0, 2)), "missing_sensitivity").when(sensitivity > grant.ceiling, "above_ceiling")
    if grant.denied_classes:
        reason = reason.when(F.coalesce(F.arrays_overlap(F.array_compact(classes), F.array(*map(F.lit, grant.denied_classes))), F.lit(False)), "class_denied")
    if grant.kinds:
        reason = reason.when(fails(kind.isin(*grant.kinds)), "type_out_of_scope")
    if grant.subjects:
        reason = reason.when(fails(F.arrays_overlap(F.array_compact(subjects), F.array(*map(F.lit, grant.subjects)))), "subject_out_of_scope")
    if grant.since or grant.until:
        inside = at >= F.to_timestamp_ntz(F.lit(grant.since)) if grant.since else at.isNotNull()
        inside = inside & (at <= F.to_timestamp_ntz(F.lit(grant.until))) if grant.until else inside
        reason = reason.when(fails(inside), "time_out_of_scope")
    return reason


#: Default and floor of each class of source, as ranks of labels; a source of no known class is private throughout (fixed values).
SOURCE_CLASSES = {
    "direct_messaging": (2, 1), "email": (2, 1), "health_biometrics": (2, 2), "calendar": (2, 1), "local_files": (2, 1), "agent_session": (2, 1),
    "public_posts": (0, 0), "saved_web": (1, 0),
}


def source_policy(source_class: Column) -> Column:
    """struct(default, floor) of a source's class."""
    known = F.create_map(*(x for k, (d, f) in SOURCE_CLASSES.items() for x in (F.lit(k), F.struct(F.lit(d).alias("default"), F.lit(f).alias("floor")))))
    return F.coalesce(F.try_element_at(known, source_class), F.struct(F.lit(2).alias("default"), F.lit(2).alias("floor")))


def any_of(one: str | int | None, many: tuple = (), most: int = 64) -> tuple:
    """A scope given as one value, as several, or both."""
    both = tuple(dict.fromkeys([*([] if one is None else [one]), *many]))
    if len(both) > most:
        raise ValueError(f"a scope names {most} values at most")
    return both


def in_scope(column: Column, scope: tuple, array: bool = False) -> Column:
    """Whether the value, or one of an array's, is in the scope; an empty scope holds all."""
    if not scope:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, scope))) if array else column.isin(*scope), F.lit(False))


def selected(claims: DataFrame, ids: DataFrame | None = None, subjects: tuple = (), sources: DataFrame | None = None) -> DataFrame:
    """Evidence by claim ids, by membership in its subjects, by source; what is not given does not restrict."""
    out = claims.where(in_scope(F.col("subjects"), subjects, array=True))
    out = out if ids is None else out.join(ids, "claim_id", "left_semi")
    return out if sources is None else out.join(sources, "source", "left_semi")


#: Content characters that a record needs; an ideograph counts as this many letters (fixed values).
CONTENT, IDEOGRAPH = 12, 4


def prefilter_reason(kind: Column, text: Column) -> Column:
    """Why a record is not worth a reading: service, empty, no_words, too_short; null if it is."""
    wide = F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}&&[\p{L}\p{N}]]"))
    content = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) + (IDEOGRAPH - 1) * wide
    blank = F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
    reason = F.when(kind.isin("service", "service_message"), "service").when(text.isNull() | blank, "empty")
    return reason.when(content == 0, "no_words").when(content < CONTENT, "too_short")


def path_classes(paths: Column, rules: dict[str, str]) -> Column:
    """Classes of the globs that one of the paths matches: ** spans folders, * and ? stay within one."""

    def expression(glob: str) -> str:
        out = ""
        for token in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob):
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
        return f"^{out}$"

    hit = lambda glob: F.exists(paths, lambda p: F.rlike(p, F.lit(expression(glob))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(hit(g), F.lit(c)) for g, c in rules.items())))))


#: What a source's grant has to allow before its rows are read (fixed values).
FIELDS = ("text", "metadata", "attachments", "participants")


def source_allows(rows: DataFrame, grants: DataFrame, purpose: str, ceiling: int, fields: tuple[str, ...] = (), owner: bool = False) -> DataFrame:
    """Rows whose source has an active grant for the purpose, and all fields asked for, with a floor within the ceiling.
    Rows without a source are the owner's alone.  ``grants``: source, active, purposes, floor; fields where they count."""
    fit = grants.where("active").where(F.array_contains("purposes", purpose) & (F.col("floor") <= ceiling))
    for f in fields:
        fit = fit.where(F.array_contains("fields", f))
    bound = rows.join(fit.select("source"), "source", "left_semi")
    return bound.unionByName(rows.where("source IS NULL")) if owner else bound


def resolved_sensitivity(floor: Column, default: Column, hint: Column, model: Column, owner: Column, override: Column) -> Column:
    """The strictest of default, the model's label, the event's hint and the owner's label, and never below the floor;
    an owner's override stands alone, and may lower.  A missing floor or default is private."""
    strict = F.greatest(F.coalesce(floor, F.lit(2)), F.coalesce(default, F.lit(2)), model, hint, owner)
    return F.when(F.coalesce(override, F.lit(False)) & owner.isNotNull(), owner).otherwise(strict)


def rate(rows: DataFrame, who: str, at: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """Calls of the last ``seconds`` at each call, itself included, whether it is over, and in how many seconds the
    oldest call that must leave the window has left it."""
    w = Window.partitionBy(who).orderBy("_us")
    span = w.rangeBetween(-(seconds * 1_000_000 - 1), 0)
    calls = rows.withColumn("_us", micros(F.col(at))).withColumn("n_window", F.count(F.lit(1)).over(span))
    calls = calls.withColumn("limited", F.col("n_window") > most)
    # of the calls in the window the one that is ``most`` calls back: when it leaves, one more fits
    back = F.lag("_us", most).over(Window.partitionBy(who).orderBy("_us", *[c for c in ("event_id",) if c in rows.columns]))
    wait = F.when(F.col("limited"), F.greatest(F.lit(0), F.ceil((back + seconds * 1_000_000 - F.col("_us")) / 1_000_000)))
    return calls.withColumn("retry_after", wait.cast("long")).drop("_us")
