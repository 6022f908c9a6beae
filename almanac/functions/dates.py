"""Column builders for dates and times as German calendars write them. Results are ISO strings, '' where nothing is found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from almanac import dictionaries as D


# The forms of a time of day, and whether they give minutes.
TIME_FORMS = [(r"(\d{1,2})(?:[:.](\d{2}))?\s+bis\s+\d{1,2}[:.]\d{2}", True), (r"(\d{1,2})[:.](\d{2})(?!\d)\s*(?:Uhr)?", True), (r"(?<!\d)(\d{1,2})\s*Uhr(?!\d)", False)]
# End of the fixed values.


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.when(day == "", F.lit("")).otherwise(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def _full_year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)


def german_date(c: Column, short_years: bool = True) -> Column:
    """First ``D.M.YYYY`` (or ``D.M.YY``); the calendar is not consulted."""
    p = r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4}|\d{2}(?!\d))" if short_years else r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    return _iso(_full_year(F.regexp_extract(c, p, 3)), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 1))


def month_number(name: Column, months: Sequence[str] = D.GERMAN_MONTHS) -> Column:
    """Number of a month's name by its first three letters, as text; '' for other words."""
    n = F.lower(name)
    return F.coalesce(*[F.when(n.startswith(m[:3]), F.lit(f"{i:02d}")) for i, m in enumerate(months, 1)], F.lit(""))


def german_month_date(c: Column, default_year: int | None = None) -> Column:
    """First ``D. Month YYYY``; with ``default_year`` the year may be missing."""
    p = r"(?U)(\d{1,2})\.\s*([A-Za-zäöüÄÖÜ]{3,})\.?\s*(\d{4})" if default_year is None else r"(?U)(\d{1,2})\.\s*([A-Za-zäöüÄÖÜ]{3,})\.?\s*(\d{4})?"
    month = month_number(F.regexp_extract(c, p, 2))
    year = F.regexp_extract(c, p, 3)
    if default_year is not None:
        year = F.when(year == "", F.lit(str(default_year))).otherwise(year)
    return F.when(month == "", F.lit("")).otherwise(_iso(year, month, F.regexp_extract(c, p, 1)))


def day_month(c: Column, year: int) -> Column:
    """First ``D.M.`` in a given year."""
    p = r"(\d{1,2})\.\s*(\d{1,2})\."
    return _iso(F.lit(str(year)), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 1))


def iso_date(c: Column) -> Column:
    """Leading ISO date, padded or not, with or without time and offset; '' if there is no such day."""
    p = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})"
    out = _iso(F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3))
    return F.when(F.try_to_date(out, "yyyy-MM-dd").isNull(), F.lit("")).otherwise(out)


def iso_time(c: Column) -> Column:
    """Wall time of an ISO timestamp; its offset is dropped."""
    return F.regexp_extract(c, r"\d[T ](\d{2}:\d{2})", 1)


def rss_date(c: Column) -> Column:
    """Date of an RSS pubDate, its offset dropped."""
    p = r"(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})"
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    at = F.array_position(months, F.regexp_extract(c, p, 2))
    return F.when(at == 0, F.lit("")).otherwise(_iso(F.regexp_extract(c, p, 3), at.cast("string"), F.regexp_extract(c, p, 1)))


def epoch_berlin(seconds: Column, by_month: bool = True) -> Column:
    """Local wall time of epoch seconds. ``by_month`` takes summer time to last from March to October, as the feeds' reader does; else the true rule holds."""
    utc = F.timestamp_seconds(seconds)
    if not by_month:
        return F.from_utc_timestamp(utc, "Europe/Berlin")
    return F.timestamp_seconds(seconds + F.when(F.month(utc).between(3, 10), 7200).otherwise(3600))


def date_range(c: Column) -> tuple[Column, Column]:
    """Start and end of ``A bis B``, ``D1. & D2.M.Y``, ``D1-D2.M.Y``, ``D1. und D2.M.Y``, or of a single date (end '')."""
    all_dates = F.regexp_extract_all(c, F.lit(r"(\d{1,2}\.\s*\d{1,2}\.\s*(?:\d{4}|\d{2}(?!\d)))"), F.lit(1))
    short = r"(\d{1,2})\.?\s*(?:&|-|–|und|bis)\s*(\d{1,2})\.(\d{1,2})\.(\d{4})"
    first, last = F.regexp_extract(c, short, 1), F.regexp_extract(c, short, 2)
    month, year = F.regexp_extract(c, short, 3), F.regexp_extract(c, short, 4)
    two = F.size(all_dates) >= 2
    start = F.when(two, german_date(F.get(all_dates, F.lit(0)))).when(first != "", _iso(year, month, first)).otherwise(german_date(c))
    end = F.when(two, german_date(F.get(all_dates, F.lit(1)))).when(first != "", _iso(year, month, last)).otherwise(F.lit(""))
    return start, end


def start_time(c: Column) -> Column:
    """First time of day in a text, dates set aside: ``H bis H:MM`` by its start, ``H:MM``, ``H Uhr``."""
    t = F.regexp_replace(c, r"\d{1,2}\.\d{1,2}\.\d{2,4}", " ")

    def shown(pattern: str, minutes: bool) -> Column:
        h, m = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2) if minutes else F.lit("00")
        m = F.when(m == "", F.lit("00")).otherwise(m)
        return F.when((h != "") & (h.try_cast("int") <= 23) & (m.try_cast("int") <= 59), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))

    return F.coalesce(*[shown(p, minutes) for p, minutes in TIME_FORMS], F.lit(""))


def twelve_hours(c: Column) -> Column:
    """``H:MM AM`` or ``PM`` as 24 hours; '' else."""
    p = r"(?i)(\d{1,2}):(\d{2})\s*([ap])\.?m"
    h = F.regexp_extract(c, p, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(c, p, 3)) == "p", 12).otherwise(0)
    return F.coalesce(F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(c, p, 2)), F.lit(""))


def is_past(c: Column, today: Column) -> Column:
    """Whether an ISO date, padded or not, lies before ``today``; what is empty or no date counts as past."""
    return F.coalesce(F.try_to_date(c, "yyyy-M-d") < today, F.lit(True))


def next_months(day: Column, count: int) -> Column:
    """First days of the month and of those that follow it."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.add_months(F.trunc(day, "MM"), k))
