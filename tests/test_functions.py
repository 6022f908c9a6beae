from pyspark.sql import functions as F

import pytest

from almanac.functions import dates, ids, text


def values(spark, cases, build, name="v"):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, {name} string")
    return [r[0] for r in frame.orderBy("i").select(build(F.col(name)).alias("o")).collect()]


CASES = [
    (text.normalize_title, [("Markt in Spöck", "markt"), ("A - B", "a  b"), ("Büchig-Fest Büchig", "büchigfest"), (None, ""), ("  X/Y ", "xy"), ("Spöck", "spöck"), ("Fest Blankenloch heute", "fest heute")]),
    (text.title_key_cased, [("Markt Spöck", "markt spöck"), (" Markt in spöck ", "markt"), (None, "")]),
    (text.normalize_location, [("Halle, Str. 1", "Halle"), (", Str. 1", ", Str. 1"), ("  Halle ", "Halle"), (None, "")]),
    (text.normalize_location_dedup, [("Festplatz Büchig, Str", "büchig"), ("Walzbachhalle, x", "Weingarten"), ("Woanders, 3", "woanders"), (None, ""), ("Tollhaus", "Karlsruhe-Innenstadt")]),
    (text.normalize_organizer, [("Veranstalter:\n\t SV Staffort e.V.", "sportvereinstafforteV".lower()), (None, ""), ("A. B; C", "abc")]),
    (text.organizer_without_form, [("Verein e.V.", "verein ."), ("Turn e. V x", "turn x"), ("Eingetragener  Verein Foo", "foo"), (None, "")]),
    (text.slugify, [("Größe & Maß!", "groesse-mass"), ("!!!", "event"), ("a" * 59 + " b", "a" * 59), (None, "event"), ("--Hi  there--", "hi-there")]),
    (text.strip_html, [("<p>a <b>b</b></p>", "a b"), (None, "")]),
    (text.clean_event_url, [("http://x/?zm.sid=1a", "http://x/"), ("http://x/?a=1&zm.sid=2", "http://x/?a=1")]),
    (text.html_unescape, [("a &amp; b &eacute; &#233;", "a & b é é"), ("none", "none"), (None, None)]),
    (text.clean_description, [("<p>a&nbsp;&amp; b</p>", "a & b"), ("| x  y\n\n z", "x y z"), (None, ""), ("calc(1px) t", "t")]),
    (text.short_description, [("Text weiterlesen ", "Text"), ("...", ""), ("a &lt; b", "a < b")]),
    (text.flag_generic_title, [("Vesper", "Vesper ⚠️"), ("Kurz", "Kurz ⚠️"), ("Ein langer Titel hier", "Ein langer Titel hier")]),
    (text.without_year, [("Fest 2026", "Fest"), ("Fest (2026)", "Fest"), ("2026 Fest", "2026 Fest")]),
    (text.first_bold_line, [("x\n**Bold**\ny", "Bold"), (None, "")]),
    (dates.german_date, [("am 3.7.26 um", "2026-07-03"), ("03.12.2026", "2026-12-03"), ("none", ""), ("32.13.2026", "2026-13-32")]),
    (dates.german_month_date, [("5. Juni 2026", "2026-06-05"), ("12. März 2027", "2027-03-12"), ("5. Foo 2026", ""), ("x", "")]),
    (dates.iso_date, [("2026-2-3", "2026-02-03"), ("2026-02-30", ""), ("2026-05-01T19:30:00+02:00", "2026-05-01"), ("", ""), ("2026-99-99", "")]),
    (dates.iso_time, [("2026-05-01T19:30:00+02:00", "19:30"), ("2026-05-01", "")]),
    (dates.rss_date, [("Fri, 05 Jun 2026 10:00:00 +0200", "2026-06-05"), ("x", "")]),
    (dates.start_time, [("29.05.2026 16 bis 16.45 Uhr", "16:00"), ("um 19.30 Uhr", "19:30"), ("ab 19 Uhr", "19:00"), ("25:00", ""), ("ohne", "")]),
    (dates.twelve_hours, [("7:30 PM", "19:30"), ("12:05 am", "00:05"), ("x", "")]),
]


@pytest.mark.parametrize("build,cases", CASES, ids=[c[0].__name__ for c in CASES])
def test_table(spark, build, cases):
    assert values(spark, [c for c, _ in cases], build) == [w for _, w in cases]


def test_ranges(spark):
    cases = {"3.7.2026 bis 5.7.2026": ("2026-07-03", "2026-07-05"), "22.-25.05.2026": ("2026-05-22", "2026-05-25"), "1. & 2.3.2026": ("2026-03-01", "2026-03-02"), "1. und 2.3.2026": ("2026-03-01", "2026-03-02"), "4.4.2026": ("2026-04-04", ""), "x": ("", "")}
    for k, (a, b) in cases.items():
        assert (values(spark, [k], lambda c: dates.date_range(c)[0]), values(spark, [k], lambda c: dates.date_range(c)[1])) == ([a], [b]), k


def test_past(spark):
    today = F.lit("2026-02-03").cast("date")
    assert values(spark, ["2026-2-3", "2026-02-02", "", None, "soon", "2026-02-04"], lambda c: dates.is_past(c, today)) == [False, True, True, True, True, False]


def test_epoch(spark):
    got = spark.range(1).select(dates.epoch_berlin(F.lit(1773576000)).cast("string").alias("a"), dates.epoch_berlin(F.lit(1773576000), False).cast("string").alias("b")).first()
    assert (got.a, got.b) == ("2026-03-15 14:00:00", "2026-03-15 13:00:00")


def test_similar_and_lists(spark):
    rows = spark.createDataFrame([("Fest 2.", "fest 3"), ("Sommerfest am See", "sommerfest"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(text.title_similar(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    assert values(spark, [" a, b ,,c", None], text.as_list) == [["a", "b", "c"], []]


def test_ids(spark):
    import hashlib

    got = spark.createDataFrame([("u", "t", "d"), (None, "t", "d"), ("", "t", None)], "u string, t string, d string").select(ids.event_id(F.col("u"), F.col("t"), F.col("d")), ids.group_id63(F.col("t")), ids.group_id31(F.col("t"))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [r[0] for r in got] == [int(sha(k)[:13], 16) for k in ("u", "t|d", "t|")]
    assert got[0][1] == int.from_bytes(hashlib.sha256(b"t").digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF
    assert got[0][2] == int(hashlib.md5(b"t").hexdigest(), 16) % 2**31


def test_collisions(spark):
    rows = [(f"f{i:02d}", f"u{i % 3}" if i % 4 else None, f"t{i}", "d") for i in range(24)]
    out = ids.resolve_collisions(spark.createDataFrame(rows, "file string, url string, title string, date string"), "url", "title", "date", "file").collect()
    assert len({r.id for r in out}) == len(rows)
    import hashlib

    h = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:13], 16)
    seen, want = set(), {}
    for k, (f, u, t, d) in enumerate(rows):
        v = h(u or f"{t}|{d}")
        if v in seen:
            v = h(f"{u or ''}|{t}|{k}")
        seen.add(v)
        want[f] = v
    assert {r.file: r.id for r in out} == want
