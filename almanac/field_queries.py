"""Field functions and repair rules as queries over rows written from the driver's tables, with their SQL.

Every row of ``orders`` becomes an event: its fields are chosen from short lists by the row's key, with lists of
different lengths, so that most combinations occur. Dates are written from the order's own date in the forms that
calendars use, and the SQL says which day is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from almanac import dictionaries as D
from almanac.functions import dates, ids, text
from almanac.operators import dedup, landing, rules, series, tagging
from almanac.queries import RAW_SQL, SQL, query
from almanac.storage import table

TITLES = ["Messen im Turnier", "Gottesdienst", "Cheerleading Tryout", "CVJM Abend", "Jam Session", " Vesper ", "Rosen im Garten", "Konzert", "Sportplatz", None, '"Lange Nacht"', '""', "Fest 2026"]
BODIES = [
    "Treffpunkt: 18:30 Uhr, Am Rathaus. Rückkehr offen", "Beginn: 19.30 im Saal", "Blumen und Pflanzen", "", None, "Cello und Musik", "Wettkampf im Stadion", "Treffpunkt Alter Bahnhof. Danach mehr", "von 9:15 an",
    "10:00 - 12:00 im Haus", "<b>Kurz</b> gesagt weiterlesen ", "Andacht in der Kirche",
]
PLACES = ["", "Büchig", "Blankenloch, Halle", " ZKM , Saal", None, "Spoecker Weg 3", "Stutensee-Rathaus"]
HOSTS = ["Veranstalter: SV Staffort e.V.", "CVJM Ort", None, "", "Kulturkreis e. V. Spöck", "SV Staffort e.V."]
URLS = ["https://linkenheim.example/a?zm.sid=4711", "https://a.example/Waldstadt/b", None, "https://a.example/kategorie/kunst-und-mehr/7", "https://a.example/Kategorie/sport?x=1&zm.sid=9"]
TAGS = ["Kirche,Sport", "", "Musik", "Sport,Büchig", "⚠️"]


def _pick(values: list[str | None], key: str = "o_orderkey") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _pick_sql(values: list[str | None], key: str = "o_orderkey") -> str:
    return f"([{', '.join(map(_quoted, values))}])[({key} % {len(values)} + 1)::INT]"


EVENTS_SQL = f"""ev AS (SELECT o_orderkey AS ord, {_pick_sql(TITLES)} AS title, {_pick_sql(BODIES)} AS description, {_pick_sql(PLACES)} AS location, {_pick_sql(HOSTS)} AS organizer, {_pick_sql(URLS)} AS event_url,
  CASE WHEN o_orderkey % 3 = 0 THEN '20:00' ELSE '' END AS time_raw, strftime(o_orderdate, '%Y-%m-%d') AS date_start, list_filter(string_split({_pick_sql(TAGS)}, ','), lambda x: x <> '') AS tags FROM orders)"""


def written_events(spark, d):
    """Events written from all orders."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), _pick(TITLES).alias("title"), _pick(BODIES).alias("description"), _pick(PLACES).alias("location"), _pick(HOSTS).alias("organizer"), _pick(URLS).alias("event_url"),
        F.when(F.col("o_orderkey") % 3 == 0, "20:00").otherwise("").alias("time_raw"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"), F.filter(F.split(_pick(TAGS), ","), lambda x: x != "").alias("tags"),
    )


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_quoted(w)})" for w in words) + ")"


def _in(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


# --- rules --------------------------------------------------------------------------

SAID = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
_plain = [p.replace("(?iu)", "(?i)") for p in rules.TIME_PATTERNS]
_TIME = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(description, {_quoted(p)}) THEN regexp_extract(description, {_quoted(p)}, 1) END" for p in _plain) + ")"
_MEET = [p.replace("(?iu)", "(?i)") for p in rules.MEETING_POINTS]
_ONE = rf"regexp_replace({_trim(f'regexp_extract(description, {_quoted(_MEET[0])}, 1)')}, '\.+$', '')"
_TWO = _trim(f"regexp_extract(description, {_quoted(_MEET[1])}, 1)")
_TITLE = _trim("coalesce(title, '')")
_PLACE = f"CASE WHEN length({_ONE}) > 3 THEN {_ONE} WHEN length({_TWO}) > 3 THEN {_TWO} END"
_CVJM = "CASE WHEN contains(lower(coalesce(organizer, '')), 'cvjm') THEN 'CVJM-Marienhof' WHEN contains(lower(coalesce(title, '')), 'cvjm') THEN 'CVJM-Zentrum' END"
_HOST = "regexp_replace(" + _trim("coalesce(organizer, '')") + r", '(?i)^Veranstalter:\s*', '')"
for _a, _b in D.ORGANIZER_ALIASES.items():
    _HOST = f"replace({_HOST}, {_quoted(_a)}, {_quoted(_b)})"
_HOST = _trim(_HOST)
_URL_PLACE = "CASE " + " ".join(f"WHEN contains(lower(coalesce(event_url, '')), {_quoted(k)}) THEN {_quoted(v)}" for k, v in rules.URL_DISTRICTS.items()) + " END"
_MORE = "list_filter([" + ", ".join(
    f"CASE WHEN {_any(SAID, words)} AND NOT list_contains(tags, '{tag}') THEN '{tag}' END" for tag, words in [("Sport", rules.CHEER_CHILDREN), ("Kinder", rules.CHEER_CHILDREN), ("Musik", rules.MUSIC_TERMS), ("Fest", rules.FEAST_TERMS)]
) + "], lambda x: x IS NOT NULL)"


def _without(tag: str) -> str:
    return f"list_filter(tags, lambda x: x <> '{tag}')"


#: Query, rule, field, test and new value of every rule that can change a row, in the order of application.
RULE_SQL = [
    ("q01_empty_location", "fix_empty_location", "location", f"{_trim('location')} = '' AND {_CVJM} IS NOT NULL", _CVJM),
    ("q02_time_forms", "fix_time_in_description", "time_raw", f"{_trim('time_raw')} = '' AND {_TIME} IS NOT NULL", f"replace({_TIME}, '.', ':')"),
    ("q04_church", "fix_tag_church_false_positive", "tags", f"list_contains(tags, 'Kirche') AND {_any(SAID, rules.CHURCH_FALSE)} AND NOT {_any(SAID, rules.CHURCH_TERMS)}", _without("Kirche")),
    ("q05_sport", "fix_tag_sport_false_positive", "tags", f"list_contains(tags, 'Sport') AND {_any(SAID, rules.SPORT_FALSE)} AND NOT {_any(SAID, rules.SPORT_TERMS)}", _without("Sport")),
    ("q06_generic_title", "fix_generic_title", "tags", f"lower({_TITLE}) IN {_in(rules.WARNED_TITLES)} AND NOT list_contains(tags, '⚠️')", "list_append(tags, '⚠️')"),
    ("q07_meeting_point", "fix_location_from_treffpunkt", "location", f"{_trim('location')} = '' AND {_PLACE} IS NOT NULL", _PLACE),
    ("q08_garden", "fix_sport_tag_garden_false_positive", "tags", f"list_contains(tags, 'Sport') AND {_any(SAID, rules.GARDEN_TERMS)} AND NOT {_any(SAID, rules.GARDEN_SPORT)}", _without("Sport")),
    ("q09_organizer", "fix_organizer_prefix_and_alias", "organizer", f"coalesce(organizer, '') <> '' AND {_HOST} <> {_trim('organizer')}", _HOST),
    ("q10_cheerleading", "fix_tag_cheerleading_sport", "tags", f"{_any(SAID, rules.CHEER_TERMS)} AND NOT list_contains(tags, 'Sport')", "list_append(tags, 'Sport')"),
    ("q11_district_of_url", "fix_district_from_url", "tags", f"NOT list_has_any(tags, [{', '.join(map(_quoted, rules.KNOWN_DISTRICTS))}]) AND {_URL_PLACE} IS NOT NULL", f"list_append(tags, {_URL_PLACE})"),
    ("q12_more_specific", "fix_tag_more_specific", "tags", f"len({_MORE}) > 0", f"list_concat(tags, {_MORE})"),
    ("q13_place_tag", "fix_location_district_suffix", "tags", f"{_trim('coalesce(location, chr(32))')} IN {_in(rules.PLACE_DISTRICTS)} AND NOT list_contains(tags, {_trim('location')})", f"list_append(tags, {_trim('location')})"),
]
_SHOWN = "ord, location, time_raw, organizer, array_to_string(tags, ',') AS tags, array_to_string(applied, ',') AS applied"


def _rules_sql(steps, source: str) -> str:
    ctes, last = [source], "s0"
    ctes.append("s0 AS (SELECT *, []::VARCHAR[] AS applied FROM ev)")
    for i, (_, name, column, test, value) in enumerate(steps, 1):
        ctes.append(f"t{i} AS MATERIALIZED (SELECT *, coalesce({test}, false) AS hit FROM {last})")
        ctes.append(f"s{i} AS MATERIALIZED (SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN {value} ELSE {column} END AS {column}, CASE WHEN hit THEN list_append(applied, '{name}') ELSE applied END AS applied) FROM t{i})")
        last = f"s{i}"
    return f"WITH {', '.join(ctes)} SELECT {_SHOWN} FROM {last}"


def _ruled(rows, names=None):
    return rules.apply_rules(rows, names).select("ord", "location", "time_raw", "organizer", F.array_join("tags", ",").alias("tags"), F.array_join("applied_rules", ",").alias("applied"))


def _rule_query(step):
    def run(spark, d):
        return _ruled(written_events(spark, d), [step[1]])

    run.__name__ = step[0]
    run.__doc__ = f"The rule {step[1]} alone."
    return run


for _step in RULE_SQL:
    query(_rules_sql([_step], EVENTS_SQL))(_rule_query(_step))


@query(_rules_sql(RULE_SQL, EVENTS_SQL))
def q14_rules_in_order(spark, d):
    """All rules, each on what the ones before it left."""
    return _ruled(written_events(spark, d))


# The same rules over documents as raw events, whose query stands beside the other operators.
SQL["q14_all_rules"] = _rules_sql(RULE_SQL, RAW_SQL + ", ev AS (SELECT *, ['Sport', 'Kirche'] AS tags FROM raw)")


# --- text ---------------------------------------------------------------------------

_FIRST = _trim("coalesce(location, '')")
_BEFORE = f"CASE WHEN strpos(lower({_FIRST}), ',') > 1 THEN {_trim(f'split_part(lower({_FIRST}), chr(44), 1)')} ELSE lower({_FIRST}) END"
_PLACE_KEY = "CASE " + " ".join(f"WHEN contains(lower(location), {_quoted(w)}) THEN {_quoted(w)}" for w in D.CORE_DISTRICTS) + " " + " ".join(f"WHEN {_any('lower(location)', words)} THEN {_quoted(n)}" for n, words in D.DISTRICTS.items()) + f" ELSE {_BEFORE} END"


@query(f"WITH {EVENTS_SQL} SELECT ord, {_PLACE_KEY} AS place FROM ev")
def n04_place_blocks(spark, d):
    return written_events(spark, d).select("ord", text.normalize_location_dedup(F.col("location")).alias("place"))


@query(rf"WITH {EVENTS_SQL} SELECT ord, {_HOST} AS stored, regexp_replace(lower(coalesce(organizer, '')), '[\s.,;:-]+', '', 'g') AS plain, regexp_replace(lower({_HOST}), '[\s.,;:-]+', '', 'g') AS key FROM ev")
def n06_organizers(spark, d):
    o = text.empty(F.col("organizer"))
    return written_events(spark, d).select("ord", text.clean_organizer(text.strip(o)).alias("stored"), text.squeeze(o).alias("plain"), text.normalize_organizer(text.strip(o)).alias("key"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN '' ELSE c_name END AS name FROM customer")
def n13_first_names(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 3
    one = F.struct(F.col("c_name").alias("name"))
    body = F.when(k == 0, F.to_json(F.struct(one.alias("location")))).when(k == 1, F.to_json(F.struct(F.array(one, F.struct(F.lit("Other").alias("name"))).alias("location")))).otherwise(F.lit('{"location": null}'))
    return c.select("c_custkey", text.first_name(body, "location").alias("name"))


@query(rf"WITH {EVENTS_SQL} SELECT ord, regexp_replace(regexp_replace(event_url, '[?&]zm\.sid=[^&]+', '', 'g'), '[?&]+$', '') AS url FROM ev")
def n14_clean_urls(spark, d):
    return written_events(spark, d).select("ord", text.clean_event_url(F.col("event_url")).alias("url"))


@query(f"WITH {EVENTS_SQL}, s AS (SELECT ord, regexp_extract(lower(event_url), '/kategorie/([^/?#]+)', 1) AS s FROM ev) SELECT ord, CASE s WHEN 'kunst-und-mehr' THEN 'Kunst Und Mehr' WHEN 'sport' THEN 'Bewegung' ELSE '' END AS category FROM s")
def n15_url_categories(spark, d):
    return written_events(spark, d).select("ord", text.url_category(F.col("event_url"), {"sport": "Bewegung"}, "/kategorie/").alias("category"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ,, '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def n16_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.as_list(F.replace(F.col("p_name"), F.lit(" "), F.lit(" ,, "))), "|").alias("parts"))


_YEARS = [" 2026", " (2025)", "", " 1999", " 2030 "]


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN trim(p_name) || ' 1999' ELSE trim(p_name) END AS title FROM part")
def n17_titles_without_year(spark, d):
    return table(spark, d, "part").select("p_partkey", text.without_year(F.concat(F.trim("p_name"), _pick(_YEARS, "p_partkey"))).alias("title"))


@query(rf"WITH {EVENTS_SQL}, s AS (SELECT ord, regexp_replace(regexp_replace(coalesce(description, ''), '<[^>]*>', '', 'g'), '(?i)\s*weiterlesen\s*$', '') AS s FROM ev) SELECT ord, CASE WHEN trim(s) = '...' THEN '' ELSE s END AS short FROM s")
def n21_short_descriptions(spark, d):
    return written_events(spark, d).select("ord", text.short_description(F.col("description")).alias("short"))


@query(rf"""WITH {EVENTS_SQL} SELECT ord, CASE WHEN lower({_trim('title')}) IN {_in(D.GENERIC_TITLES)} OR (len(list_filter(regexp_split_to_array({_trim('title')}, '\s+'), lambda w: w <> '')) <= 2 AND length(title) < 20) THEN title || ' ⚠️' ELSE title END AS title,
CASE ord % 4 WHEN 0 THEN '—' WHEN 1 THEN '✅ ' || printf('%.2f', (ord % 100) / 100.0) WHEN 2 THEN '❌ ' || printf('%.2f', (ord % 100) / 100.0) ELSE '❌ 0.00' END AS badge FROM ev""")
def n23_flags_and_badges(spark, d):
    k = F.col("ord") % 4
    passed, score = F.when(k == 1, True).when(k > 1, False), F.when(k < 3, (F.col("ord") % 100) / 100)
    return written_events(spark, d).select("ord", text.flag_generic_title(F.col("title")).alias("title"), text.quality_badge(passed, score).alias("badge"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'The' WHEN contains(lower(text), 'ei') THEN 'EI' ELSE 'none' END AS label FROM documents")
def n25_first_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_label(F.col("text"), ["The", "EI"], "none").alias("label"))


@query("SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS h FROM nation")
def h05_row_hashes(spark, d):
    return table(spark, d, "nation").select("n_nationkey", ids.row_hash("n_regionkey", "n_nationkey", "n_name").alias("h"))


_NUMBERS = ["1.5", "x", "", None, "-3", "1e2", "1,5"]


@query(f"SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1.5 WHEN 4 THEN -3 WHEN 5 THEN 100 ELSE 0 END::DOUBLE AS x FROM orders")
def h06_floats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.as_float(_pick(_NUMBERS)).alias("x"))


@query(rf"""WITH {EVENTS_SQL}, b AS (SELECT ord, date_start, CASE WHEN length(title) > 2 AND starts_with(title, '"') AND ends_with(title, '"') THEN trim(title[2:-2]) ELSE title END AS t FROM ev) SELECT ord, CASE WHEN trim(t) = '' THEN 'Untitled (' || date_start || ')' ELSE t END AS title FROM b""")
def p05_quoted_titles(spark, d):
    """Titles without quotes; some are empty."""
    return written_events(spark, d).select("ord", landing.unquoted_title(F.col("title"), F.col("date_start")).alias("title"))


_ORDERED = {"Blankenloch": ["blankenloch"], "Büchig": ["büchig"], "Stutensee": ["stutensee"]}


@query(f"WITH {EVENTS_SQL} SELECT ord, CASE " + " ".join(f"WHEN {_any('lower(location)', words)} THEN {_quoted(n)}" for n, words in _ORDERED.items()) + " END AS district FROM ev")
def g06_ordered_districts(spark, d):
    return written_events(spark, d).select("ord", tagging.first_pattern(F.lower(F.col("location")), _ORDERED).alias("district"))


# --- dates --------------------------------------------------------------------------


def _dated(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT o_orderkey, '20' || strftime(o_orderdate, '%y-%m-%d') AS day FROM orders")
def t02_short_years(spark, d):
    return _dated(spark, d).select("o_orderkey", dates.german_date(F.concat(F.lit("am "), F.date_format("day", "d.M.yy"), F.lit(" um drei"))).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '2026' || strftime(o_orderdate, '-%m-%d') AS this_year FROM orders")
def t03_month_names(spark, d):
    name = F.element_at(F.array(*[F.lit(m.capitalize()) for m in D.GERMAN_MONTHS]), F.month("day"))
    head = F.concat(F.lit("Sa, "), F.dayofmonth("day").cast("string"), F.lit(". "), name)
    return _dated(spark, d).select("o_orderkey", dates.german_month_date(F.concat(head, F.lit(" "), F.year("day").cast("string"))).alias("day"), dates.german_month_date(F.concat(head, F.lit(" im Saal")), 2026).alias("this_year"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '12:30' AS at, '' AS never FROM orders")
def t04_iso_dates(spark, d):
    loose = F.concat(F.date_format("day", "yyyy-M-d"), F.lit("T12:30:00+02:00"))
    return _dated(spark, d).select("o_orderkey", dates.iso_date(loose).alias("day"), dates.iso_time(loose).alias("at"), dates.iso_date(F.concat(F.date_format("day", "yyyy"), F.lit("-02-30"))).alias("never"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def t05_feed_dates(spark, d):
    return _dated(spark, d).select("o_orderkey", dates.rss_date(F.date_format("day", "EEE, dd MMM yyyy '08:00:00 +0200'")).alias("day"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-03') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS first,
CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-05') ELSE '' END AS last FROM orders""")
def t07_date_ranges(spark, d):
    k = F.col("o_orderkey") % 3
    one = F.date_format("day", "d.M.yyyy")
    said = F.when(k == 0, F.concat(one, F.lit(" bis "), F.date_format(F.date_add("day", 9), "dd.MM.yyyy"))).when(k == 1, F.concat(F.lit("3. & 5."), F.date_format("day", "M.yyyy"))).otherwise(F.concat(F.lit("am "), one))
    first, last = dates.date_range(said)
    return _dated(spark, d).select("o_orderkey", first.alias("first"), last.alias("last"))


@query("SELECT o_orderkey, '2026' || strftime(o_orderdate, '-%m-%d') AS day FROM orders")
def t08_days_without_year(spark, d):
    return _dated(spark, d).select("o_orderkey", dates.day_month(F.concat(F.lit("Di "), F.date_format("day", "d. M."), F.lit(" ab drei")), 2026).alias("day"))


@query("SELECT event_id, CASE event_id % 3 WHEN 1 THEN strftime(ts, '%H:00') ELSE strftime(ts, '%H:%M') END AS at, strftime(ts, '%H:%M') AS of_twelve FROM events")
def t09_times(spark, d):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.date_format("ts", "'am 3.4.2026 um 'H:mm' Uhr'")).when(k == 1, F.date_format("ts", "'gegen 'H' Uhr'")).otherwise(F.concat(F.date_format("ts", "H:mm"), F.lit(" bis 23:59")))
    return table(spark, d, "events").select("event_id", dates.start_time(said).alias("at"), dates.twelve_hours(F.date_format("ts", "h:mm a")).alias("of_twelve"))


# --- joins --------------------------------------------------------------------------


@query(f"""WITH {EVENTS_SQL}, o AS (SELECT *, ord AS id FROM ev WHERE title IS NOT NULL), p AS (SELECT id, lower(title) AS t, date_start AS day FROM o WHERE length(trim(coalesce(description, ''))) BETWEEN 1 AND 4),
r AS (SELECT DISTINCT lower(title) AS t, date_start AS day, description AS d FROM o WHERE length(description) > 5), f AS (SELECT p.id, r.d, row_number() OVER (PARTITION BY p.id ORDER BY length(r.d) DESC, r.d DESC) AS n FROM p JOIN r ON r.day = p.day AND contains(r.t, p.t))
SELECT o.id, CASE WHEN length(trim(coalesce(o.description, ''))) BETWEEN 1 AND 4 THEN coalesce(f.d, '') ELSE o.description END AS description FROM o LEFT JOIN f ON f.id = o.id AND f.n = 1""".replace(_quoted(BODIES[5]), "'kurz'"))
def d10_looked_up(spark, d):
    """Descriptions of one to four letters looked up among the rows of the day."""
    rows = written_events(spark, d).filter("title is not null").withColumn("description", F.when(F.col("description") == BODIES[5], "kurz").otherwise(F.col("description"))).withColumnRenamed("ord", "id")
    return dedup.look_up_descriptions(rows, rows).select("id", "description")


@query(f"WITH {EVENTS_SQL}, o AS (SELECT ord, regexp_replace(lower(coalesce(organizer, '')), '[\\s.,;:-]+', '', 'g') AS o, regexp_replace(lower({_pick_sql(['SV Staffort', 'Kulturkreis e.V.', 'CVJM', 'Ort'], 'ord')}), '[\\s.,;:-]+', '', 'g') AS p FROM ev) SELECT ord, contains(o, p) OR contains(p, o) AS contain, o = p AS same FROM o")
def d15_organizer_guard(spark, d):
    a, b = text.squeeze(F.col("organizer")), text.squeeze(_pick(["SV Staffort", "Kulturkreis e.V.", "CVJM", "Ort"], "ord"))
    return written_events(spark, d).select("ord", dedup.compatible(a, b, "contain").alias("contain"), dedup.compatible(a, b, "equal").alias("same"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS v FROM events), s AS (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
SELECT event_id, max(v) OVER (PARTITION BY user_id, g) AS title FROM s""")
def r05_carried_titles(spark, d):
    """The last title of each user's events, where no row uses it up."""
    e = table(spark, d, "events").withColumn("takes", F.lit(False))
    return series.carried(e, "user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")), "title").select("event_id", "title")
