"""Recurrence rules of calendar events, expanded by day with built-in functions.

An event's periods (weeks, months, years) up to its end of search are a sequence,
each with the few days that its rule could mean; the rule is a filter over that
array.  Events of one date and rule have the same days, found once; they meet
their events again by a join, and an event stays one row until it is exploded.  The time of day stays with the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weekday codes, Monday first, and the rule parts that are understood (fixed values).
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
PARTS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "WKST")


def _part(rule: Column, name: str) -> Column:
    return F.regexp_extract(rule, rf"(?:^|;){name}=([^;]*)", 1)


def _list(rule: Column, name: str) -> Column:
    return F.filter(F.split(_part(rule, name), ","), lambda x: x != "")


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def supported(rule: Column) -> Column:
    """Whether each part is known and means something for its frequency: positions of weekdays by month or year only,
    days of the month not by day or week, no other parts by day.  Pieces without a sign of equality are passed over."""
    known = F.forall(F.filter(F.split(rule, ";"), lambda p: F.contains(p, F.lit("="))), lambda p: F.rlike(p, F.lit(rf"^({'|'.join(PARTS)})=.+$")))
    freq, days = _part(rule, "FREQ"), _list(rule, "BYDAY")
    codes = F.forall(days, lambda x: F.rlike(x, F.lit(rf"^([+-]?[1-9]\d?)?({'|'.join(WEEKDAYS)})$")))
    numbers = F.forall(_list(rule, "BYMONTHDAY"), lambda x: F.rlike(x, F.lit(r"^[+-]?0*([1-9]|[12]\d|3[01])$"))) & F.forall(_list(rule, "BYMONTH"), lambda x: F.rlike(x, F.lit(r"^\+?0*([1-9]|1[0-2])$")))
    counts = F.rlike(F.coalesce(F.nullif(_part(rule, "INTERVAL"), F.lit("")), F.lit("1")), F.lit(r"^[1-9]\d{0,5}$")) & F.rlike(_part(rule, "COUNT"), F.lit(r"^([1-9]\d{0,5})?$"))
    until = (_part(rule, "UNTIL") == "") | F.rlike(_part(rule, "UNTIL"), F.lit(r"^\d{8}(T\d{6}Z)?$")) & F.try_to_date(F.substring(_part(rule, "UNTIL"), 1, 8), "yyyyMMdd").isNotNull()
    bare = F.forall(days, lambda x: F.length(x) == 2)
    by = F.when(freq == "DAILY", F.size(F.concat(days, _list(rule, "BYMONTHDAY"), _list(rule, "BYMONTH"))) == 0)
    by = by.when(freq == "WEEKLY", bare & (F.size(F.concat(_list(rule, "BYMONTHDAY"), _list(rule, "BYMONTH"))) == 0))
    by = by.when(freq == "MONTHLY", F.size(_list(rule, "BYMONTH")) == 0).when(freq == "YEARLY", True).otherwise(False)
    return F.coalesce(known & codes & numbers & counts & until & by, F.lit(False))


def _parsed(rule: Column) -> dict[str, Column]:
    """The rule's parts as columns, so that they are read once an event and not once a day."""
    day = lambda x: F.struct(F.right(x, F.lit(2)).alias("code"), _whole(F.regexp_extract(x, r"^([+-]?\d+)", 1)).alias("place"))
    return {
        "r_ok": supported(rule), "r_freq": _part(rule, "FREQ"), "r_interval": F.coalesce(_whole(_part(rule, "INTERVAL")), F.lit(1)), "r_count": _whole(_part(rule, "COUNT")),
        "r_until": F.try_to_date(F.substring(_part(rule, "UNTIL"), 1, 8), "yyyyMMdd"), "r_days": F.transform(_list(rule, "BYDAY"), day),
        "r_month_days": F.transform(_list(rule, "BYMONTHDAY"), _whole), "r_months": F.transform(_list(rule, "BYMONTH"), _whole),
        "r_first": F.greatest(F.array_position(F.array(*map(F.lit, WEEKDAYS)), _part(rule, "WKST")).cast("int"), F.lit(1)) - 1,
    }


def _fits(d: Column) -> Column:
    """Whether day ``d`` is an occurrence, counts and exceptions aside."""
    start, freq, days, month_days, months = (F.col(f"r_{c}") for c in ("start", "freq", "days", "month_days", "months"))
    week = lambda x: F.floor((F.datediff(x, F.lit("1970-01-05").cast("date")) - F.col("r_first")) / 7)
    period = F.when(freq == "DAILY", F.datediff(d, start)).when(freq == "WEEKLY", week(d) - week(start))
    period = period.when(freq == "MONTHLY", (F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)).otherwise(F.year(d) - F.year(start))
    code = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(d) + 1)
    month_end = F.dayofmonth(F.last_day(d))
    by_year = (freq == "YEARLY") & (F.size(months) == 0)
    at = F.when(by_year, F.dayofyear(d)).otherwise(F.dayofmonth(d))
    end = F.when(by_year, F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))).otherwise(month_end)
    places = F.floor((at - 1) / 7) + 1, -(F.floor((end - at) / 7) + 1)
    on_day = (F.size(days) == 0) | F.exists(days, lambda x: (x["code"] == code) & (x["place"].isNull() | x["place"].isin(*places)))
    on_month_day = (F.size(month_days) == 0) | F.exists(month_days, lambda x: x.isin(F.dayofmonth(d), F.dayofmonth(d) - month_end - 1))
    on_month = (F.size(months) == 0) | F.array_contains(months, F.month(d))
    plain = (F.size(days) == 0) & (F.size(month_days) == 0)
    usual = F.when(~plain | (freq == "DAILY"), True).when(freq == "WEEKLY", F.weekday(d) == F.weekday(start))
    usual = usual.otherwise((F.dayofmonth(d) == F.dayofmonth(start)) & ((freq == "MONTHLY") | (F.size(months) > 0) | (F.month(d) == F.month(start))))
    return (F.pmod(period, F.col("r_interval")) == 0) & on_day & on_month_day & on_month & usual


def _candidates() -> Column:
    """Days from r_start to r_last among which are all that fit the rule: one or a few for each of its periods."""
    start, last, freq, step = F.col("r_start"), F.col("r_last"), F.col("r_freq"), F.col("r_interval")
    periods = lambda n: F.sequence(F.lit(0), F.greatest(F.floor(n / step).cast("int"), F.lit(0)))
    day_number = lambda x: F.array_position(F.array(*map(F.lit, WEEKDAYS)), x["code"]).cast("int") - 1
    days = F.col("r_days")
    since = F.pmod(F.weekday(start) - F.col("r_first"), F.lit(7))
    week = lambda i: F.date_add(start, (i * step * 7 - since).cast("int"))
    on = F.when(F.size(days) == 0, F.array(since.cast("int"))).otherwise(F.transform(days, lambda x: F.pmod(day_number(x) - F.col("r_first"), F.lit(7)).cast("int")))
    weekly = F.flatten(F.transform(periods(F.floor(F.datediff(last, start) / 7) + 1), lambda i: F.transform(on, lambda d: F.date_add(week(i), d))))
    daily = F.transform(periods(F.datediff(last, start)), lambda i: F.date_add(start, (i * step).cast("int")))
    n_years = F.year(last) - F.year(start)
    monthly = F.transform(periods(n_years * 12 + F.month(last) - F.month(start)), lambda i: F.add_months(F.trunc(start, "month"), (i * step).cast("int")))
    plain = (F.size(days) == 0) & (F.size("r_month_days") == 0)
    named = F.when(F.size("r_months") > 0, F.col("r_months")).when(plain, F.array(F.month(start))).otherwise(F.sequence(F.lit(1), F.lit(12)))
    yearly = F.flatten(F.transform(periods(n_years), lambda i: F.transform(named, lambda m: F.make_date((F.year(start) + i * step).cast("int"), m, F.lit(1)))))

    def inside(m: Column) -> Column:
        by_day = F.flatten(F.transform(days, lambda x: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.date_add(m, (F.pmod(day_number(x) - F.weekday(m), F.lit(7)) + 7 * k).cast("int")))))
        by_number = F.transform("r_month_days", lambda x: F.when(x > 0, F.date_add(m, x - 1)).otherwise(F.date_add(F.last_day(m), x + 1)))
        return F.when(F.size("r_month_days") > 0, by_number).when(F.size(days) > 0, by_day).otherwise(F.array(F.date_add(m, F.dayofmonth(start) - 1)))

    months = F.flatten(F.transform(F.when(freq == "MONTHLY", monthly).otherwise(yearly), inside))
    return F.filter(F.when(freq == "DAILY", daily).when(freq == "WEEKLY", weekly).otherwise(months), lambda d: d.between(start, last))


def _found(kinds: DataFrame, alike: list[str], most: int) -> DataFrame:
    """``kinds`` with the days of each in ``r_found``."""
    none = F.array().cast("array<date>")
    rows = kinds.withColumns(_parsed(F.col("r_rule"))).withColumn("r_last", F.when(F.col("r_ok"), F.least("r_end", "r_until")))
    days = F.when(F.col("r_start") <= F.col("r_last"), F.array_sort(F.array_distinct(_candidates()))).otherwise(none)
    # each array is named once in what follows, so it is made once
    found = F.slice(F.filter(days, _fits), F.lit(1), F.coalesce("r_count", F.lit(2**31 - 1)))
    kept = F.filter(F.array_sort(F.array_distinct(F.concat(found, "r_more"))), lambda d: ~F.array_contains("r_without", d))
    kept = F.reverse(F.slice(F.reverse(kept), 1, most))
    return rows.select(*alike, F.when(F.col("r_ok"), kept).otherwise(F.array("r_start")).alias("r_found"))


def expanded(events: DataFrame, key: str, start: str, rule: str, until: Column, without: str | None = None, more: str | None = None, most: int = 1000) -> DataFrame:
    """(key, n, day): a row for each day on which an event of date ``start`` takes place, none after ``until``; n from 0.

    COUNT counts the days in ``without``, which then go; days in ``more`` join unless they are in ``without``; dates
    that a month lacks are skipped; of more than ``most`` days the last stay.  A rule that is empty or not understood
    gives the start alone, a null start or end none.  Other columns are dropped whatever they are called."""
    none = F.array().cast("array<date>")
    extra = lambda c: F.coalesce(F.col(c), none) if c else none
    rows = events.select(F.col(key).alias("r_key"), F.col(start).cast("date").alias("r_start"), until.cast("date").alias("r_end"), F.upper(F.trim(F.coalesce(rule, F.lit("")))).alias("r_rule"), extra(without).alias("r_without"), extra(more).alias("r_more"))
    rows = rows.where("r_start IS NOT NULL AND r_end IS NOT NULL")
    # events of one date and rule have the same days, found once; a small table would else be one task
    alike = ["r_start", "r_end", "r_rule", "r_without", "r_more"]
    dealt = 4 * events.sparkSession.sparkContext.defaultParallelism
    kinds = rows.select(*alike).distinct().repartition(dealt)
    met = rows.repartition(dealt).join(_found(kinds, alike, most), alike)
    # outer: of an inner one Catalyst infers that the array has days, and asks so of every event before equal ones are one
    return met.select(F.col("r_key").alias(key), F.posexplode_outer("r_found").alias("n", "day")).where("day IS NOT NULL")
