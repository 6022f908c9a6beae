"""Repair rules as column transforms, applied in order; ``applied_rules`` names those that changed a row.

A rule is registered with ``rule``; it takes an accessor for the row's fields and gives a test and the
fields it would change. Where it reads a null that it cannot work with, it does not apply.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import text
from almanac.operators.tagging import first_match

Row = Callable[[str], Column]
Rule = Callable[[Row], tuple[Column, dict[str, Column]]]
RULES: dict[str, Rule] = {}

#: The fields that rules read or change.
FIELDS = {**dict.fromkeys(["title", "location", "organizer", "description", "time_raw", "event_url"], "string"), "tags": "array<string>"}

# The rules' word lists.
CHURCH_FALSE = ["messen", "schach", "chess", "turnier"]
CHURCH_TERMS = ["gottesdienst", "kirche", "gemeinde", "andacht", "posaunen", "kirchen"]
SPORT_FALSE = ["jam session", "jam-session", "musik", "konzert", "cello"]
SPORT_TERMS = ["sport", "turnen", "fußball", "fussball", "training", "wettkampf", "athletik", "sportplatz"]
WARNED_TITLES = ["gottesdienst", "gottesdienst mit posaunenchor", "oekumenischer gottesdienst", "center", "lichtblick", "maenner vesper", "vesper", "altpapiersammlung", "kinoabend"]
GARDEN_TERMS = ["garten", "blüten", "blume", "blumen", "rose", "rosen", "pflanze", "pflanzen", "gärtner", "gartenpracht"]
GARDEN_SPORT = ["sportplatz", "stadion", "fitness", "training", "laufen", "radfahren", "wettkampf"]
CHEER_TERMS = ["cheer", "cheerleading", "cheerleader", "tryout"]
CHEER_CHILDREN = ["cheer", "cheerleader", "cheerleading"]
MUSIC_TERMS = ["musik", "konzert", "live-musik", "amadeus"]
FEAST_TERMS = ["fest", "adventsfest"]
URL_DISTRICTS = {
    "graben-neudorf": "Graben-Neudorf", "graben_neudorf": "Graben-Neudorf", "linkenheim": "Linkenheim", "leopoldshafen": "Leopoldshafen", "bruchsal": "Bruchsal", "blankenloch": "Blankenloch",
    "friedrichstal": "Friedrichstal", "spöck": "Spöck", "staffort": "Staffort", "büchig": "Büchig", "buechig": "Büchig", "weingarten": "Weingarten", "eggenstein": "Eggenstein", "neuthard": "Neuthard",
    "karlsdorf": "Neuthard", "waldstadt": "Waldstadt", "neureut": "Neureut", "rintheim": "Rintheim", "hagsfeld": "Hagsfeld", "büchenau": "Büchenau", "buechenau": "Büchenau",
}
KNOWN_DISTRICTS = ["Blankenloch", "Bruchsal", "Büchenau", "Büchig", "Eggenstein", "Friedrichstal", "Graben-Neudorf", "Hagsfeld", "Leopoldshafen", "Linkenheim", "Neureut", "Neuthard", "Rintheim", "Spöck", "Staffort", "Waldstadt", "Weingarten"]
PLACE_DISTRICTS = ["Büchig", "Weingarten", "Bruchsal", "Neuthard", "Karlsdorf", "Spöck", "Blankenloch", "Friedrichstal", "Staffort", "Linkenheim", "Graben-Neudorf", "Waldstadt", "Neureut", "Rintheim", "Hagsfeld"]
TIME_PATTERNS = [r"(?iu)(\d{1,2}[:.]\d{2})\s*Uhr", r"(?iu)Beginn[:\s]*(\d{1,2}[:.]\d{2})", r"(?iu)von\s*(\d{1,2}[:.]\d{2})", r"(\d{1,2}[:.]\d{2})\s*-\s*\d{1,2}[:.]\d{2}"]
MEETING_POINTS = [r"(?iu)Treffpunkt[:\s]*(?:\d{1,2}[:.]\d{2}\s*Uhr\s*[,.]?\s*)?(.+?)(?:Rückkehr|Gebühr|\.\s|$)", r"(?iu)Treffpunkt[:\s]+(.+?)[.\n]"]
# End of the fixed values.

#: What may not follow a time at a pattern's end: more digits make it a part of an address, a date or a longer number.
NO_MORE_DIGITS = r"(?!\.?\d)"


def rule(f: Rule):
    RULES[f.__name__] = f
    return f


def _tags(row: Row) -> Column:
    return F.coalesce(row("tags"), F.array().cast("array<string>"))


def _has(row: Row, tag: str) -> Column:
    return F.array_contains(_tags(row), tag)


def _add(row: Row, *tags: str | Column) -> Column:
    return F.concat(_tags(row), F.array(*[t if isinstance(t, Column) else F.lit(t) for t in tags]))


def _said(row: Row) -> Column:
    """Title and description in lower case."""
    return F.lower(F.concat(text.empty(row("title")), F.lit(" "), text.empty(row("description"))))


def _blank(row: Row, name: str) -> Column:
    """Whether a field is empty; null, so that the rule fails, where it is null."""
    return text.strip(row(name)) == ""


@rule
def fix_empty_location(row):
    place = F.when(F.contains(F.lower(text.empty(row("organizer"))), F.lit("cvjm")), "CVJM-Marienhof").when(F.contains(F.lower(text.empty(row("title"))), F.lit("cvjm")), "CVJM-Zentrum")
    return _blank(row, "location") & place.isNotNull(), {"location": place}


@rule
def fix_time_in_description(row):
    patterns = [p + NO_MORE_DIGITS if p.endswith(")") else p for p in TIME_PATTERNS]
    found = F.coalesce(*[F.when(row("description").rlike(p), F.regexp_extract(row("description"), p, 1)) for p in patterns])
    return _blank(row, "time_raw") & found.isNotNull(), {"time_raw": F.replace(found, F.lit("."), F.lit(":"))}


@rule
def fix_empty_description(row):
    return F.lit(False), {"description": row("description")}


@rule
def fix_tag_church_false_positive(row):
    return _has(row, "Kirche") & text.contains_any(_said(row), CHURCH_FALSE) & ~text.contains_any(_said(row), CHURCH_TERMS), {"tags": F.array_remove(_tags(row), "Kirche")}


@rule
def fix_tag_sport_false_positive(row):
    return _has(row, "Sport") & text.contains_any(_said(row), SPORT_FALSE) & ~text.contains_any(_said(row), SPORT_TERMS), {"tags": F.array_remove(_tags(row), "Sport")}


@rule
def fix_generic_title(row):
    return F.lower(text.strip(text.empty(row("title")))).isin(WARNED_TITLES) & ~_has(row, "⚠️"), {"tags": _add(row, "⚠️")}


@rule
def fix_location_from_treffpunkt(row):
    one = F.regexp_replace(text.strip(F.regexp_extract(row("description"), MEETING_POINTS[0], 1)), r"\.+$", "")
    two = text.strip(F.regexp_extract(row("description"), MEETING_POINTS[1], 1))
    place = F.when(F.length(one) > 3, one).when(F.length(two) > 3, two)
    return _blank(row, "location") & place.isNotNull(), {"location": place}


@rule
def fix_sport_tag_garden_false_positive(row):
    return _has(row, "Sport") & text.contains_any(_said(row), GARDEN_TERMS) & ~text.contains_any(_said(row), GARDEN_SPORT), {"tags": F.array_remove(_tags(row), "Sport")}


@rule
def fix_organizer_prefix_and_alias(row):
    clean = text.clean_organizer(text.strip(text.empty(row("organizer"))))
    return (text.strip(text.empty(row("organizer"))) != "") & (clean != text.strip(row("organizer"))), {"organizer": clean}


@rule
def fix_tag_cheerleading_sport(row):
    return text.contains_any(_said(row), CHEER_TERMS) & ~_has(row, "Sport"), {"tags": _add(row, "Sport")}


@rule
def fix_district_from_url(row):
    found = first_match(F.lower(text.empty(row("event_url"))), URL_DISTRICTS)
    return ~F.exists(_tags(row), lambda t: t.isin(KNOWN_DISTRICTS)) & found.isNotNull(), {"tags": _add(row, found)}


@rule
def fix_tag_more_specific(row):
    wanted = [("Sport", CHEER_CHILDREN), ("Kinder", CHEER_CHILDREN), ("Musik", MUSIC_TERMS), ("Fest", FEAST_TERMS)]
    more = F.filter(F.array(*[F.when(text.contains_any(_said(row), words) & ~_has(row, tag), F.lit(tag)) for tag, words in wanted]), lambda t: t.isNotNull())
    return F.size(more) > 0, {"tags": F.concat(_tags(row), more)}


@rule
def fix_location_district_suffix(row):
    place = text.strip(text.empty(row("location")))
    return place.isin(PLACE_DISTRICTS) & ~F.array_contains(_tags(row), place), {"tags": _add(row, place)}


def apply_rules(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Every rule in order, each on what the ones before it left. Adds ``applied_rules``.

    The row passes from rule to rule as a lambda's argument, so each rule's expressions
    are there once, however often it and its followers read a field.
    """
    fields = [c for c in df.columns if c in FIELDS]

    def step(state: Column, name: str) -> Column:
        def run(s: Column) -> Column:
            test, changes = RULES[name](lambda f: s[f] if f in fields else F.lit(None).cast(FIELDS[f]))
            # The test is bound once as well.
            return F.transform(F.array(F.coalesce(test, F.lit(False))), lambda hit: F.struct(
                *[(F.when(hit, changes[f]).otherwise(s[f]) if f in changes else s[f]).alias(f) for f in fields],
                F.when(hit, F.array_append(s["applied_rules"], F.lit(name))).otherwise(s["applied_rules"]).alias("applied_rules"),
            ))[0]

        return F.transform(F.array(state), run)[0]

    state = F.struct(*fields, F.array().cast("array<string>").alias("applied_rules"))
    for name in names or RULES:
        state = step(state, name)
    out = df.withColumn("__state", state)
    return out.select(*[F.col(f"__state.{c}").alias(c) if c in fields else F.col(c) for c in df.columns], "__state.applied_rules")


def split_changed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that a rule changed, and the others."""
    return df.filter(F.size("applied_rules") > 0), df.filter(F.size("applied_rules") == 0)
