"""Parsers of landed pages and feeds: each turns a table of payloads into event records.

The network stays outside: a source is a landed ``pages(page_id, url, html)`` table, a
JSON, an RSS or a line table, and one of these layouts with its patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.functions import dates, text
from almanac.operators.landing import RAW_SCHEMA, union_all


@dataclass(frozen=True)
class Layout:
    """Patterns of a block layout: where blocks are, and for each field the group 1 of a pattern in the block."""

    block: str
    fields: dict[str, str]
    date: Callable[[Column], Column] = dates.german_date
    constants: dict[str, str] = field(default_factory=dict)
    require: tuple[str, ...] = ()


def blocks(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """``page_id, pos, block``: every match of group 1 of a pattern in a page, in order."""
    found = F.regexp_extract_all(text.empty(F.col(html)), F.lit("(?s)" + pattern), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "block"))


def html_blocks(pages: DataFrame, layout: Layout, html: str = "html") -> DataFrame:
    """Events of pages whose entries are repeated blocks; a date that does not parse is ''."""
    rows = blocks(pages, layout.block, html)
    out = {f: text.strip(text.decode_basic(F.regexp_replace(F.regexp_extract("block", "(?s)" + p, 1), "<[^>]+>", ""))) for f, p in layout.fields.items() if f != "date_start"}
    if "date_start" in layout.fields:
        out["date_start"] = layout.date(F.regexp_extract("block", "(?s)" + layout.fields["date_start"], 1))
    out |= {k: F.lit(v) for k, v in layout.constants.items()}
    events = rows.select("page_id", "pos", *[c.alias(f) for f, c in out.items()])
    for f in layout.require:
        events = events.filter(text.empty(F.col(f)) != "")
    return events


def json_ld(pages: DataFrame, kind: str = "Event", html: str = "html") -> DataFrame:
    """Events from JSON-LD scripts, single objects, lists or ``@graph``; malformed ones are skipped, offsets dropped."""
    rows = blocks(pages, r'<script type="application/ld\+json">(.*?)</script>', html)
    many = F.coalesce(F.from_json(F.get_json_object("block", "$['@graph']"), "array<string>"), F.from_json(F.when(F.trim("block").startswith("["), F.col("block")), "array<string>"), F.array("block"))
    each = rows.select("page_id", "pos", F.explode(many).alias("o")).filter(F.get_json_object("o", "$['@type']") == kind)
    get = lambda k: text.empty(F.get_json_object("o", f"$.{k}"))
    out = each.select(
        "page_id", "pos", get("name").alias("title"), dates.iso_date(get("startDate")).alias("date_start"), dates.iso_date(get("endDate")).alias("date_end"), dates.iso_time(get("startDate")).alias("time_raw"),
        text.first_name(F.col("o"), "location").alias("location"), text.first_name(F.col("o"), "organizer").alias("organizer"), text.html_unescape(text.strip(F.regexp_replace(get("description"), "<[^>]+>", ""))).alias("description"), get("url").alias("event_url"),
    )
    return out.filter("date_start <> ''")


REST_EVENT = "title string, start_date string, end_date string, venue string, organizer string, description string, url string"


def rest_events(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Events of REST pages ``{"events": [...]}``: the venue may be an object or a list, organizers are joined by '; ', text is decoded twice, a time needs more than a date."""
    each = payloads.select(F.posexplode(F.from_json(F.get_json_object(column, "$.events"), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in REST_EVENT.split(', '))}>>")).alias("pos", "e"))
    venue = lambda k: text.empty(F.coalesce(F.get_json_object("e.venue", f"$.{k}"), F.get_json_object("e.venue", f"$[0].{k}")))
    twice = lambda c: text.html_unescape(text.html_unescape(text.empty(c)))
    people = F.array_join(F.transform(F.from_json("e.organizer", "array<struct<organizer:string>>"), lambda o: o["organizer"]), "; ")
    place = F.array_join(F.filter(F.array(venue("venue"), venue("address"), F.concat_ws(" ", F.nullif(venue("zip"), F.lit("")), F.nullif(venue("city"), F.lit("")))), lambda x: x != ""), ", ")
    return each.select(
        "pos", twice(F.col("e.title")).alias("title"), F.substring("e.start_date", 1, 10).alias("date_start"), F.substring("e.end_date", 1, 10).alias("date_end"),
        F.when(F.length("e.start_date") > 16, F.substring("e.start_date", 12, 5)).otherwise("").alias("time_raw"), twice(place).alias("location"), twice(people).alias("organizer"),
        text.strip_html(twice(F.col("e.description"))).alias("description"), text.empty(F.col("e.url")).alias("event_url"),
    )


def rss_items(feeds: DataFrame, column: str = "body", skip: str | None = None) -> DataFrame:
    """Items of RSS feeds: title, link, description, date of publication; items that a pattern matches are skipped."""
    rows = feeds.select(F.posexplode(F.regexp_extract_all(column, F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("pos", "item"))

    def tag(name: str) -> Column:
        return text.strip(text.decode_basic(F.regexp_extract("item", rf"(?s)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)))

    out = rows.select("pos", tag("title").alias("title"), text.clean_event_url(tag("link")).alias("event_url"), text.strip_html(tag("description")).alias("description"), dates.rss_date(tag("pubDate")).alias("date_start"))
    return out if skip is None else out.filter(~F.col("title").rlike(skip))


def table_rows(pages: DataFrame, cells: Sequence[str], html: str = "html") -> DataFrame:
    """Rows of HTML tables with at least as many cells as names."""
    rows = blocks(pages, r"<tr[^>]*>(.*?)</tr>", html).withColumn("cells", F.transform(F.regexp_extract_all("block", F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: text.strip_html(c)))
    return rows.filter(F.size("cells") >= len(cells)).select("page_id", "pos", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(cells)])


def page_lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, pos, line``: a page's text, a line for each piece between tags."""
    body = F.regexp_replace(text.empty(F.col(html)), r"(?is)<(script|style)\b.*?</\1>", "\n")
    pieces = F.filter(F.transform(F.split(F.regexp_replace(body, "<[^>]+>", "\n"), "\n"), lambda x: text.strip(text.decode_basic(x))), lambda x: x != "")
    return pages.select("page_id", F.posexplode(pieces).alias("pos", "line"))


def dated_lines(pages: DataFrame, date_line: str = r"^\d{2}\.\d{2}\.\d{2}$", time_line: str = r"^[\d:ab\s-]+Uhr", html: str = "html") -> DataFrame:
    """Events of a line list: a date line, then perhaps a time line, then the title.

    Each date line looks at the two lines after it inside its page's own array, so a page is
    never split and pages never meet.
    """
    body = F.regexp_replace(text.empty(F.col(html)), r"(?is)<(script|style)\b.*?</\1>", "\n")
    lines = F.filter(F.transform(F.split(F.regexp_replace(body, "<[^>]+>", "\n"), "\n"), lambda x: text.strip(text.decode_basic(x))), lambda x: x != "")
    each = pages.select("page_id", lines.alias("lines")).select("page_id", "lines", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(date_line))
    next_ = lambda k: F.get("lines", F.col("pos") + k)
    timed = next_(1).rlike(time_line)
    title = F.when(timed, next_(2)).otherwise(next_(1))
    return each.select("page_id", "pos", dates.german_date(F.col("line")).alias("date_start"), F.when(timed, F.trim(F.substring_index(next_(1), ",", 1))).otherwise("").alias("time_raw"), title.alias("title")).filter("title is not null")


def windows_after(pages: DataFrame, heading: str, width: int = 10_000, html: str = "html") -> DataFrame:
    """``page_id, pos, heading, body``: up to ``width`` characters after each heading, whatever follows."""
    p = rf"(?s)({heading})(?=(.{{0,{width}}}))"
    c = text.empty(F.col(html))
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("heading"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("body"))
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "w")).select("page_id", "pos", "w.heading", "w.body")


def literal_events(spark: SparkSession, rows: Sequence[dict], source: str = "manual_override") -> DataFrame:
    """Events given in the program."""
    names = [x.split()[0] for x in RAW_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_SCHEMA).withColumn("source_url", F.lit(source))


def envelopes(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Events of envelopes ``{"source_url", "events": [...]}``."""
    shape = "source_url string, events array<struct<" + ", ".join(x.replace(" ", ":", 1) for x in RAW_SCHEMA.split(", ")) + ">>"
    return payloads.select(F.from_json(column, shape).alias("e")).select(F.col("e.source_url").alias("source_url"), F.posexplode("e.events").alias("pos", "v")).select("source_url", "pos", "v.*")


def without_cancelled(df: DataFrame, pattern: str = r"(?iu)ENTFÄLLT|abgesagt|cancelled") -> DataFrame:
    return df.filter(~F.col("title").rlike(pattern))


def merged_sources(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Sources one after another, each only with the keys that none before it has."""
    out = frames[0]
    for f in frames[1:]:
        out = union_all([out, f.join(out.select(*key), [*key], "left_anti")])
    return out


def upcoming(df: DataFrame, day: str, with_today: bool = True) -> DataFrame:
    """Events from ``day`` on, or after it."""
    return df.filter((F.col("date_start") >= day) if with_today else (F.col("date_start") > day)).filter("date_start <> ''")


def ends_after_start(df: DataFrame) -> DataFrame:
    """An end before the start is none."""
    return df.withColumn("date_end", F.when(F.col("date_end") >= F.col("date_start"), F.col("date_end")))


def titled_by_place(df: DataFrame, generic: Sequence[str]) -> DataFrame:
    """Titles that say nothing by themselves get their place in brackets."""
    says_little = F.lower(text.strip(F.col("title"))).isin([g.lower() for g in generic]) & (text.empty(F.col("location")) != "")
    return df.withColumn("title", F.when(says_little, F.concat("title", F.lit(" ("), "location", F.lit(")"))).otherwise(F.col("title")))


def heading_events(pages: DataFrame, heading: str, day: str, width: int = 10_000) -> DataFrame:
    """Events whose heading a pattern matches: the first date in the heading or in what follows it, after ``day``; dates at the end of titles go."""
    rows = windows_after(pages, heading, width)
    plain = text.strip_html(F.col("heading"))
    said = F.concat_ws(" ", plain, text.strip_html(F.col("body")))
    when = F.coalesce(F.nullif(dates.german_date(said), F.lit("")), dates.german_month_date(said))
    title = text.strip(F.regexp_replace(plain, r"[\s,–-]*\d{1,2}\.\s*(?:\d{1,2}\.|\p{L}+)\s*(?:\d{2,4})?\s*$", ""))
    return upcoming(rows.select("page_id", "pos", title.alias("title"), when.alias("date_start"), dates.start_time(said).alias("time_raw")), day, with_today=False)


def with_cards(items: DataFrame, cards: DataFrame, columns: Sequence[str], key: str = "date_start") -> DataFrame:
    """List items, the first for each key, with the fields of the card of that key."""
    from almanac.operators.dedup import overlay
    from almanac.operators.landing import distinct_first

    one = distinct_first(cards, [key], ["page_id", "pos"])
    return overlay(distinct_first(items, [key], ["page_id", "pos"]), one, key, columns)


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Register a source: a function from a landed table and the day of the run to event records."""

    def keep(f):
        SOURCES[name] = f
        return f

    return keep


def relative_url(base: str, link: Column) -> Column:
    """A link made absolute against its site."""
    root = re.match(r"https?://[^/]+", base)[0]
    return F.when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(F.lit(root), link)).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), link))
