"""Recurring series and date generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from almanac.functions import ids, text


def gaps(df: DataFrame, key: str, day: str) -> DataFrame:
    """``key, gap``: days between successive dates of a key; the same date twice is a gap of 0.

    Dates are counted before they are ordered, so a hot key brings one row for each
    date it has, not one for each event.
    """
    days = df.filter(F.col(day).isNotNull() & F.col(key).isNotNull()).groupBy(key, day).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key).orderBy(day)
    step = days.withColumn("gap", F.date_diff(F.col(day), F.lag(day).over(w)))
    return step.filter("gap is not null").select(key, "gap", F.lit(1).cast("long").alias("times")).unionByName(days.filter("__n > 1").select(key, F.lit(0).alias("gap"), (F.col("__n") - 1).alias("times")))


def patterns(df: DataFrame, key: str, day: str, mode: str = "strict", weekly: int = 7, biweekly: int = 14, monthly: tuple[int, int] = (28, 31)) -> DataFrame:
    """``key, pattern`` of the series among the keys: weekly, biweekly or monthly.

    ``strict``: every gap fits. ``majority``: more than half of them do.
    """
    n, fits = F.sum("times"), {}
    for name, test in (("weekly", F.col("gap") == weekly), ("biweekly", F.col("gap") == biweekly), ("monthly", F.col("gap").between(*monthly))):
        hit = F.coalesce(F.sum(F.when(test, F.col("times"))), F.lit(0))
        fits[name] = hit == n if mode == "strict" else hit * 2 > n
    found = gaps(df, key, day).groupBy(key).agg(F.coalesce(*[F.when(t, F.lit(p)) for p, t in fits.items()]).alias("pattern"))
    return found.filter("pattern is not null")


def mark_recurring(df: DataFrame, mode: str = "strict", title: str = "title", normalized: str = "normalized_title", date: str = "date_start") -> DataFrame:
    """Adds ``recurring_group_id``: a hash of the series' key, null outside series. Dates that are none belong to no series.

    ``strict`` keys by the normalized title, or the title where that is empty, and hashes to 63 bits; ``majority`` keys by the title as it is and hashes to 31.
    """
    strict = mode == "strict"
    key = F.coalesce(F.when(F.col(normalized) == "", F.lit(None)).otherwise(F.col(normalized)), F.col(title)) if strict else text.empty(F.col(title))
    keyed = df.withColumn("__key", key).withColumn("__day", F.try_to_date(F.col(date), "yyyy-M-d"))
    found = patterns(keyed, "__key", "__day", mode).select("__key", (ids.group_id63 if strict else ids.group_id31)(F.col("__key")).alias("__id"))
    out = keyed.join(found, "__key", "left").withColumn("recurring_group_id", F.when(F.col("__day").isNotNull(), F.col("__id")))
    return out.drop("__key", "__day", "__id")


def next_weekdays(spark: SparkSession, day: str, weekday: int, count: int) -> DataFrame:
    """``date_start``: the next ``count`` days of a weekday (Monday is 0), ``day`` included."""
    d = F.lit(day).cast("date")
    first = F.date_add(d, F.pmod(F.lit(weekday) - F.weekday(d), F.lit(7)))
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")).select(F.date_add(first, F.col("k") * 7).alias("date_start"))


def month_weekdays(spark: SparkSession, first: str, last: str, weekday: int, places: list[int] | None = None, skip_months: tuple[int, ...] = ()) -> DataFrame:
    """``date_start``: all days of a weekday from ``first`` to ``last``, only the ``places``-th of each month if given, none in skipped months."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_start"))
    out = days.filter((F.weekday("date_start") == weekday) & ~F.month("date_start").isin([*skip_months]))
    place = F.ceil(F.dayofmonth("date_start") / 7).cast("int")
    return out if places is None else out.filter(place.isin(places))


def carried(df: DataFrame, partition: str, order: str, value: Column, into: str) -> DataFrame:
    """The last non-null value at or before each row, used up by the row that takes it: a row after a taker starts empty."""
    w = Window.partitionBy(partition).orderBy(order)
    taker = F.lag(value.isNull() & F.col("takes"), 1, False).over(w)
    run = df.withColumn("__run", F.sum(F.coalesce(taker, F.lit(False)).cast("int")).over(w))
    return run.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(partition, "__run").orderBy(order))).drop("__run")


def segments(c: Column, mark: str) -> Column:
    """``mark`` (a regular expression) and the text that follows up to the next, as an array of structs."""
    marks = F.regexp_extract_all(c, F.lit(f"({mark})"), F.lit(1))
    rest = F.slice(F.split(c, mark), 2, 1_000_000)
    return F.transform(F.arrays_zip(marks.alias("mark"), rest.alias("body")), lambda s: F.struct(s["mark"].alias("mark"), text.strip(text.empty(s["body"])).alias("body")))


def earliest_pattern(c: Column, patterns: list[str]) -> Column:
    """What the pattern matches that begins first in a text; null without a match."""
    spots = [F.struct(F.regexp_instr(c, F.lit(p)).alias("at"), F.regexp_extract(c, p, 0).alias("found")) for p in patterns]
    return F.array_min(F.filter(F.array(*spots), lambda s: s["at"] > 0))["found"]
