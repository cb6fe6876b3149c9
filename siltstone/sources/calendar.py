"""Calendar files as events: folded lines, begin and end of blocks, parameters, recurrences.

A file is one value, so its blocks are found inside its row and no window or
shuffle is needed.  A block that is not an event is set aside with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import recurrence

_LINE = r"^([A-Za-z-]+)((?:;[A-Za-z-]+=(?:\"[^\"]*\"|[^\":;])*)*):(.*)$"


def _plain(text: Column) -> Column:
    """Escaped text as it reads."""
    marked = F.regexp_replace(text, r"\\\\", "\x00")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"\\[nN]", "\n"), r"\\(.)", "$1"), "\x00", r"\\")


def _lines(block: Column) -> Column:
    """Lines of a block as struct(name, params, value), those of blocks inside it left out."""
    own = F.regexp_replace(block, r"(?s)BEGIN:([A-Z-]+)\r?\n.*?END:\1(?:\r?\n|\z)", "")
    part = lambda x, i: F.regexp_extract(x, _LINE, i)
    return F.transform(F.filter(F.split(own, r"\r?\n"), lambda x: F.rlike(x, F.lit(_LINE))), lambda x: F.struct(F.upper(part(x, 1)).alias("name"), F.upper(part(x, 2)).alias("params"), part(x, 3).alias("value")))


def _value(name: str) -> Column:
    return F.try_element_at(F.filter("lines", lambda x: x["name"] == name), F.lit(1))


def _instant(c: Column) -> Column:
    """Date or date and time, as written, without its zone."""
    return F.coalesce(F.try_to_timestamp(F.substring(c, 1, 15), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(F.substring(c, 1, 8), F.lit("yyyyMMdd"))).cast("timestamp_ntz")


def _dates(name: str) -> Column:
    found = F.flatten(F.transform(F.filter("lines", lambda x: x["name"] == name), lambda x: F.split(x["value"], ",")))
    return F.filter(F.transform(found, lambda v: F.try_to_date(F.substring(v, 1, 8), "yyyyMMdd")), lambda d: d.isNotNull())


def events(spark: SparkSession, path: str) -> DataFrame:
    """file, n, uid, start, all_day, zone, ends, summary, description, location, status, rule, without, more,
    recurrence (the occurrence that it stands for), reason (why it is set aside; null for events)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r?\n[ \t]", "").alias("text"))
    blocks = files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)BEGIN:VEVENT[ \t]*\r?\n(.*?)(?:END:VEVENT|\z)"), F.lit(1))).alias("n", "block"))
    rows = blocks.withColumn("lines", _lines(F.col("block")))
    said = lambda name: _plain(_value(name)["value"])
    start = _value("DTSTART")
    found = rows.select(
        "file", "n", F.nullif(F.trim(_value("UID")["value"]), F.lit("")).alias("uid"), _instant(start["value"]).alias("start"), (F.length(start["value"]) == 8).alias("all_day"),
        F.nullif(F.regexp_extract(start["params"], r'TZID="?([^";]+)', 1), F.lit("")).alias("zone"), _instant(_value("DTEND")["value"]).alias("ends"), said("SUMMARY").alias("summary"), said("DESCRIPTION").alias("description"),
        said("LOCATION").alias("location"), F.upper(_value("STATUS")["value"]).alias("status"), _value("RRULE")["value"].alias("rule"), _dates("EXDATE").alias("without"), _dates("RDATE").alias("more"), _instant(_value("RECURRENCE-ID")["value"]).alias("recurrence"),
    )
    return found.withColumn("reason", F.when(F.col("uid").isNull(), "uid_missing").when(F.col("start").isNull(), "start_invalid"))


def occurrences(found: DataFrame, until: Column, most: int = 1000) -> DataFrame:
    """uid, day, start, summary, status: each day on which an event takes place.  An override takes the place of the
    occurrence that it names; a cancelled one leaves none, and a cancelled master nothing at all."""
    good = found.where("reason IS NULL")
    masters = good.where("recurrence IS NULL").groupBy("uid").agg(F.max_by(F.struct("start", "summary", "status", "rule", "without", "more"), F.struct("file", "n")).alias("m")).select("uid", "m.*")
    days = recurrence.expanded(masters, "uid", "start", "rule", until, "without", "more", most).select("uid", "day")
    overrides = good.where("recurrence IS NOT NULL").groupBy("uid", F.col("recurrence").cast("date").alias("day")).agg(F.max_by(F.struct("start", "summary", "status"), F.struct("file", "n")).alias("o"))
    plain = days.join(masters.select("uid", F.date_format("start", "HH:mm:ss").alias("time"), "summary", "status"), "uid").where("status IS DISTINCT FROM 'CANCELLED'")
    met = plain.join(overrides, ["uid", "day"], "left")
    at = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), "time"))
    return met.where("o IS NULL OR o.status IS DISTINCT FROM 'CANCELLED'").select(
        "uid", "day", F.coalesce("o.start", at).alias("start"), F.coalesce("o.summary", "summary").alias("summary"), F.coalesce("o.status", "status").alias("status"),
    )
