"""The registered sources: each names its site and turns landed payloads into event records.

Class names, skip lists and constants of the sites are fixed values; the layouts that read
them are in ``parsers``. A source takes a landed table (``page_id, url, html`` for pages, ``body`` for feeds)
and the day of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.functions import dates, text
from almanac.operators import landing, series
from almanac.operators.dedup import lookup_names
from almanac.sources import parsers
from almanac.sources.parsers import Layout

# What the sites' pages look like, and the constants their events get.
BOX_SITE = {"title": r"_title[^>]*>\s*<a[^>]*>([^<]+)</a>", "event_url": r"_title[^>]*>\s*<a[^>]*href=\"([^\"]*)\"", "date_start": r",\s*(\d{1,2}\.\d{1,2}\.\d{2,4})", "time_raw": r"_time\">([^<]+)", "location": r"_location[^>]*>(?:Veranstaltungsort:)?\s*(.*?)(?:<br|</div>)", "organizer": r"_organizer[^>]*>(?:Veranstalter:)?\s*(.*?)(?:<br|</div>)", "description": r"_teaser[^>]*>([^<]+)"}
WORKSHOP_PLACE = "Mehrgenerationenhaus Bürgerwerkstatt Stutensee e.V., Seegrabenweg 5, 76297 Stutensee"
SCHOOL_PLACE = "Pestalozzi-Schule Blankenloch, Hauptstraße 100, 76297 Stutensee"
SCHOOL_SKIP = ["ferien", "keine schule"]
SPORT_PARK = "VSV Büchig-Sportpark, Waldstraße 56, 76297 Stutensee-Büchig"
SPORT_SKIP = r"(?iu)kreisklasse|\d+\s*:\s*\d+|\d+\.\s*spieltag|freundschafts.spieletag|bautagebuch|generalversammlung|mitgliederversammlung|arbeitseinsatz"
OUTSIDE = ["forbach", "karben", "immenhausen"]
VILLAGE_FEASTS = ["Maifest", "Sommerfest", "Laternenfest", "Adventsfest"]
MARKETS = [
    ("Wochenmarkt Friedrichstal", 2, "14:00 – 18:00", "Friedrichstal, Marktplatz (Oskar-Hornung-Haus)", "Wochenmarkt in Friedrichstal. Mittwochs 14:00–18:00 Uhr auf dem Marktplatz."),
    ("Wochenmarkt Blankenloch", 5, "07:00 – 13:00", "Blankenloch, Neuer Markt (Michaeliskirche)", "Wochenmarkt in Blankenloch. Samstags 07:00–13:00 Uhr am Neuen Markt."),
]
CAFE = [
    ("Skattreff", 3, None, (8, 9), "15:00 – 17:00"),
    ("Kaffee-Kuchen-Spiele", 3, None, (8, 9), "15:00 – 17:00"),
    ("Witwenstammtisch", 1, [1, 3], (), "16:00 – 19:00"),
]
# Sites whose entries are elements of a class, fields elements of classes inside: block, fields, constants.
CARD_SITES = {
    "linkenheim": ("post-entry", {"title": "post-title", "date_start": "date-time", "time_raw": "date-time", "description": "entry-content"}, {"location": "Linkenheim-Hochstetten", "organizer": ""}),
    "graben_neudorf": ("hwveranstaltung__record", {"title": "hw_record__title", "date_start": "hw_record__date", "time_raw": "hw_record__time", "organizer": "hw_record__organizer", "location": "hw_record__simpleLocation"}, {}),
    "bretten": ("views-row", {"title": "views-field-title", "date_start": "views-field-field-eventdate", "time_raw": "views-field-field-eventdate"}, {"location": "Bretten", "organizer": ""}),
    "cvjm_graben_neudorf": ("ec-item-box", {"title": "title", "date_start": "ec-date", "time_raw": "ec-date", "location": "address"}, {"organizer": "CVJM Graben-Neudorf"}),
    "karlsdorf_neuthard": ("ec-item-box", {"title": "ec-title", "date_start": "ec-date", "time_raw": "ec-date", "location": "ec-location"}, {"organizer": "Bürgerstiftung Karlsdorf-Neuthard"}),
    "hagsfeld": ("layout_upcoming", {"title": "title", "date_start": "date", "time_raw": "date", "location": "location"}, {"organizer": "Bürgerkommission Hagsfeld e.V."}),
    "bruchsal": ("zmitem", {"title": "titel", "date_start": "zmitem__time", "time_raw": "zmitem__time"}, {"location": "", "organizer": ""}),
    "ekistuwei": ("v-calfe-item", {"title": "termin-titel", "date_start": "termin-datum", "time_raw": "termin-zeit", "location": "oertlichkeit-name"}, {}),
}
GENERIC_CVJM = ["gottesdienst", "center"]
TRADE_ORGANIZER = "Gewerbeverein Stutensee"
# End of the fixed values.


def _first_of(df: DataFrame, *keys: str) -> DataFrame:
    return landing.distinct_first(df, [*keys], ["page_id", "pos"])


@parsers.source("official")
def official(pages: DataFrame, day: str) -> DataFrame:
    """Town calendar: boxes on offset pages."""
    out = parsers.html_blocks(pages, Layout(r'<div class="cVeka_box_eventDate">(.*?)<div style="clear:\s*both;">', BOX_SITE))
    return out.withColumn("organizer", text.clean_organizer(F.col("organizer")))


@parsers.source("eggenstein")
def eggenstein(pages: DataFrame, day: str) -> DataFrame:
    """The same software with stripes; date and title are required, the first of each pair stays."""
    out = parsers.html_blocks(pages, Layout(r'<div class="cVeka_stripes_eventDate(?:Odd|Even)[^"]*"[^>]*>(.*?)<div style="clear:\s*both;">', BOX_SITE, require=("title", "date_start")))
    return _first_of(out, "date_start", "title")


@parsers.source("kinderkalender")
def children(payloads: DataFrame, day: str) -> DataFrame:
    """Events REST pages."""
    return parsers.rest_events(payloads).withColumn("page_id", F.lit(0).cast("long"))


@parsers.source("meinstutensee")
def town_portal(pages: DataFrame, day: str) -> DataFrame:
    return parsers.json_ld(pages)


@parsers.source("buergerwerkstatt")
def workshop(pages: DataFrame, day: str) -> DataFrame:
    """Teasers; date and hour stand in the description."""
    out = parsers.html_blocks(pages, Layout(r'<article[^>]*class="teaser[^"]*"[^>]*>(.*?)</article>', {"title": r'entry-header-teaser"[^>]*>([^<]+)', "event_url": r'class="read-more"[^>]*href="([^"]+)"', "description": r'entry-content-teaser"[^>]*>(.*?)</div>'}, constants={"location": WORKSHOP_PLACE, "organizer": ""}))
    hour = F.regexp_extract("description", r"um\s*(\d{1,2})\s*Uhr", 1)
    return out.withColumns({"date_start": dates.german_date(F.col("description"), short_years=False), "time_raw": F.when(hour == "", "").otherwise(F.concat(F.lpad(hour, 2, "0"), F.lit(":00")))})


@parsers.source("buechigerleben")
def village(pages: DataFrame, day: str) -> DataFrame:
    """Line list: date, time, title; four feasts get the village's name; the first of each title and date stays."""
    out = parsers.dated_lines(pages).withColumn("title", F.when(F.col("title").isin(VILLAGE_FEASTS), F.concat("title", F.lit(" Büchig"))).otherwise(F.col("title")))
    return _first_of(out, "title", "date_start").withColumns({"location": F.lit("Büchig"), "organizer": F.lit("Büchig(er)leben")})


@parsers.source("blutspende")
def blood(pages: DataFrame, day: str) -> DataFrame:
    """Donation dates; the place is joined from the address lines that are no time."""
    rows = parsers.blocks(pages, r'<div\s+class="item\s+clearfix"[^>]*>(.*?)(?=<div\s+class="item\s+clearfix"|\z)')
    address = F.regexp_extract("block", r'(?s)class="adresse"[^>]*>(.*?)</div>', 1)
    lines = F.filter(F.transform(F.split(address, r"<br\s*/?>"), lambda x: text.strip_html(x)), lambda x: (x != "") & ~x.rlike(r"\d{1,2}:\d{2}"))
    kind = text.strip(F.regexp_extract("block", r'class="spendeart"[^>]*>([^<]+)', 1))
    return rows.select(
        "page_id", "pos", F.when(kind == "", "Blutspende").otherwise(kind).alias("title"), dates.german_date(F.regexp_extract("block", r"<p[^>]*>(\d{2}\.\d{2}\.\d{4})</p>", 1)).alias("date_start"),
        F.regexp_extract(address, r"(\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}\s*Uhr)", 1).alias("time_raw"), F.array_join(lines, ", ").alias("location"),
    ).filter("date_start <> ''")


@parsers.source("pestalozzi")
def school(pages: DataFrame, day: str) -> DataFrame:
    """School dates, holidays left out."""
    out = parsers.html_blocks(pages, Layout(r'<div[^>]*class="[^"]*\bevent\b[^"]*\blayout_teaser\b[^"]*"[^>]*>(.*?)</div>\s*</div>', {"title": r"<h2>(.*?)</h2>", "date_start": r'class="date">([^<]+)', "time_raw": r'class="time">([^<]+)'}, constants={"location": SCHOOL_PLACE, "organizer": "Pestalozzi-Schule Blankenloch"}, require=("title",)))
    return out.filter(~text.contains_any(F.lower("title"), SCHOOL_SKIP))


@parsers.source("waldstadt")
def forest_town(pages: DataFrame, day: str) -> DataFrame:
    """Table of dates; what is past goes, an empty date counts as past."""
    out = parsers.table_rows(pages, ["when", "time_raw", "title", "location"]).withColumn("date_start", F.coalesce(F.nullif(dates.german_date(F.col("when")), F.lit("")), dates.german_month_date(F.col("when"))))
    kept = out.filter(~dates.is_past(F.col("date_start"), F.lit(day).cast("date")))
    return _first_of(kept.withColumns({"organizer": F.lit("Bürgerverein Waldstadt e.V."), "description": F.substring("location", 1, 500)}).drop("when"), "date_start", "title")


@parsers.source("vsv_buechig")
def sport_club(feeds: DataFrame, day: str) -> DataFrame:
    """News feed: the date stands in title or description; only days after today."""
    out = parsers.rss_items(feeds, skip=SPORT_SKIP)
    said = F.concat_ws(" ", "title", "description")
    when = F.coalesce(F.nullif(dates.german_date(said), F.lit("")), dates.german_month_date(said))
    return out.withColumn("date_start", when).filter((F.col("date_start") != "") & (F.col("date_start") > day)).withColumns({"location": F.lit(SPORT_PARK), "organizer": F.lit("VSV Büchig e.V."), "page_id": F.lit(0).cast("long")})


def card_events(pages: DataFrame, block: str, fields: dict[str, str], constants: dict[str, str]) -> DataFrame:
    """Events of elements of a class: each runs to the next of its class, each field from an element of its class to the next closing block.

    Dates may be ranges, in figures or with the month's name, or stand in a ``datetime`` attribute; entries without date or title go.
    """
    mark = lambda c: rf'class="[^"]*(?<![\w-]){c}(?![\w-])[^"]*"'
    rows = parsers.blocks(pages, rf"{mark(block)}[^>]*>(.*?)(?={mark(block)}|\z)")
    inner = {f: F.regexp_extract("block", rf"(?s){mark(c)}([^>]*>.*?)</(?:div|p|h\d|li|td|time|article|section)>", 1) for f, c in fields.items()}
    plain = {f: text.strip_html(text.decode_basic(F.regexp_replace(c, "^[^>]*>", ""))) for f, c in inner.items()}
    attribute = F.regexp_extract(inner["date_start"], r'(?:datetime|content)="([^"]+)"', 1)
    start, end = dates.date_range(plain["date_start"])
    when = F.coalesce(F.nullif(dates.iso_date(attribute), F.lit("")), F.nullif(start, F.lit("")), dates.german_month_date(plain["date_start"]))
    out = {f: c for f, c in plain.items() if f not in ("date_start", "time_raw")} | {"date_start": when, "date_end": F.nullif(end, F.lit(""))}
    out["time_raw"] = F.coalesce(F.nullif(dates.iso_time(attribute), F.lit("")), dates.start_time(plain.get("time_raw", F.lit(""))))
    out["event_url"] = text.clean_event_url(text.decode_basic(F.regexp_extract("block", r'<a[^>]*href="([^"]+)"', 1)))
    out |= {k: F.lit(v) for k, v in constants.items()}
    return rows.select("page_id", "pos", *[c.alias(f) for f, c in out.items()]).filter("date_start <> '' and title <> ''")


def _card_site(name: str) -> None:
    block, fields, constants = CARD_SITES[name]

    @parsers.source(name)
    def parse(pages: DataFrame, day: str) -> DataFrame:
        out = parsers.ends_after_start(card_events(pages, block, fields, constants))
        if name == "cvjm_graben_neudorf":
            out = parsers.titled_by_place(out, GENERIC_CVJM)
        return _first_of(out, "date_start", "title") if "location" not in fields else _first_of(out, "date_start", "title", "location")


for _name in CARD_SITES:
    _card_site(_name)


@parsers.source("gewerbeverein")
def trade_association(pages: DataFrame, day: str) -> DataFrame:
    """List items ``Sa., 3.7. TITLE ab 10:00 Uhr | place``: the first for each day; the title is the first word in capitals, the year that of the run."""
    rows = parsers.blocks(pages, "<li>(.*?)</li>").withColumn("line", text.strip_html(text.decode_basic(F.col("block"))))
    title = F.regexp_extract("line", r"([A-ZÄÖÜ]{2,}(?:/[A-ZÄÖÜ]+)?)", 1)
    out = rows.select("page_id", "pos", title.alias("title"), dates.day_month(F.col("line"), int(day[:4])).alias("date_start"), dates.start_time(F.col("line")).alias("time_raw"), text.strip(F.regexp_extract("line", r"\|\s*([^|]+)$", 1)).alias("location"), F.lit(TRADE_ORGANIZER).alias("organizer"))
    return _first_of(out.filter("title <> '' and date_start <> ''"), "date_start")


@parsers.source("svstaffort")
def sports_club(pages: DataFrame, day: str) -> DataFrame:
    """Table of dates from today on; an end before the start is none."""
    out = parsers.table_rows(pages, ["from_", "to_", "title"])
    rows = out.select("page_id", "pos", "title", dates.german_date(F.col("from_")).alias("date_start"), F.nullif(dates.german_date(F.col("to_")), F.lit("")).alias("date_end"), dates.start_time(F.col("from_")).alias("time_raw"), F.lit("SV Staffort e.V.").alias("organizer"))
    return parsers.upcoming(parsers.ends_after_start(rows), day)


@parsers.source("rintheim")
def citizens(pages: DataFrame, day: str) -> DataFrame:
    """Posts under headings, dated after today by what they say."""
    return parsers.heading_events(pages, r'<h2 class="entry-title">(?:(?!</h2>).)*</h2>', day).withColumns({"location": F.lit("Karlsruhe-Rintheim"), "organizer": F.lit("Bürgerverein Rintheim")})


@parsers.source("tsg_blankenloch")
def gymnastics(pages: DataFrame, day: str) -> DataFrame:
    """Table of dates; a title's rows inside the interval kept last go."""
    out = parsers.table_rows(pages, ["when", "title", "location"])
    start, end = dates.date_range(F.col("when"))
    rows = out.select("page_id", "pos", "title", start.alias("date_start"), F.coalesce(F.nullif(end, F.lit("")), start).alias("date_end"), F.when(F.col("location") == "", "TSG Blankenloch").otherwise(F.col("location")).alias("location"), F.lit("TSG Blankenloch").alias("organizer")).filter("date_start <> ''")
    return landing.without_contained(rows, "title", "date_start", "date_end", ["page_id", "pos"])


def regional_press(events: DataFrame, places: DataFrame, organizers: DataFrame) -> DataFrame:
    """REST events (``body``, one JSON object a row) with their places and organizers looked up by id (``id, name``); the first of each day and title stays."""
    get = lambda k: text.empty(F.get_json_object("body", f"$.{k}"))
    ids = lambda k: F.from_json(F.get_json_object("body", f"$.{k}"), "array<long>")
    rows = events.select(
        F.monotonically_increasing_id().alias("page_id"), F.lit(0).alias("pos"), text.strip_html(text.html_unescape(get("title.rendered"))).alias("title"), dates.iso_date(get("meta.start_date")).alias("date_start"), dates.iso_date(get("meta.end_date")).alias("date_end"),
        F.when(get("meta.all_day").isin("true", "1"), "").otherwise(dates.iso_time(get("meta.start_date"))).alias("time_raw"), text.strip_html(text.html_unescape(get("content.rendered"))).alias("description"), get("link").alias("event_url"), ids("stec_loc").alias("loc"), ids("stec_org").alias("org"),
    ).filter("title <> ''")
    named = lookup_names(lookup_names(rows, "loc", places, "page_id", "location"), "org", organizers, "page_id", "organizer").withColumn("low", F.lower("title"))
    return _first_of(named.drop("loc", "org"), "date_start", "low").drop("low")


def weekly_markets(spark: SparkSession, day: str, weeks: int = 26) -> DataFrame:
    """Both weekly markets for the coming weeks, today included."""
    return landing.union_all([
        series.next_weekdays(spark, day, weekday, weeks).select(F.lit(title).alias("title"), F.col("date_start").cast("string").alias("date_start"), F.lit(time).alias("time_raw"), F.lit(place).alias("location"), F.lit("Stadt Stutensee").alias("organizer"), F.lit(about).alias("description"))
        for title, weekday, time, place, about in MARKETS
    ])


def cafe_meetings(spark: SparkSession, day: str) -> DataFrame:
    """The café's regular meetings for the rest of the year."""
    year = day[:4]
    return landing.union_all([
        series.month_weekdays(spark, f"{year}-01-01", f"{year}-12-31", weekday, places, skip).filter(F.col("date_start") >= F.lit(day).cast("date")).select(F.lit(title).alias("title"), F.col("date_start").cast("string").alias("date_start"), F.lit(time).alias("time_raw"), F.lit("Kult Café Friedrichstal").alias("location"))
        for title, weekday, places, skip, time in CAFE
    ])


def clubs(batches: list[DataFrame]) -> DataFrame:
    """The clubs' batches one after another, without rows that lack title or date or lie outside."""
    out = landing.union_all(batches)
    return out.filter((text.strip(text.empty(F.col("title"))) != "") & (text.empty(F.col("date_start")) != "") & ~text.contains_any(F.lower(text.empty(F.col("location"))), OUTSIDE))


def run_all(landed: dict[str, DataFrame], day: str, wanted: list[str] | None = None) -> DataFrame:
    """Raw records of all registered sources that have landed, in registry order, with ``ord``: registry place, page, place in the page."""
    frames = []
    for k, (name, parse) in enumerate(parsers.SOURCES.items()):
        if name in landed and (wanted is None or name in wanted):
            rows = parse(landed[name], day).withColumn("source_url", F.lit(name))
            place = F.lit(k).cast("long") * F.lit(1 << 48) + F.coalesce(F.col("page_id"), F.lit(0)) * F.lit(1 << 16) + F.col("pos")
            frames.append(rows.withColumn("ord", place).drop("page_id", "pos"))
    return landing.union_all(frames)
