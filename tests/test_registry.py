import json

from almanac.sources import registry
from almanac.sources.parsers import SOURCES
from tests.test_sources import pages


def test_box_sites(spark):
    box = '<div class="cVeka_box_eventDate"><div class="cVeka_box_title"> <a href="/e?x=1&amp;y=2">Fest</a></div><abbr>Fr</abbr>, 3.7.26<span class="cVeka_box_time">19:30 Uhr</span><div class="cVeka_box_location">Halle<br>x</div><div class="cVeka_box_organizer">Veranstalter: Verein</div><div class="cVeka_box_teaser">Text</div><div style="clear: both;"></div></div>'
    r = registry.official(pages(spark, box + box), "2026-01-01").collect()
    assert len(r) == 2 and (r[0].title, r[0].date_start, r[0].time_raw, r[0].location, r[0].organizer, r[0].description, r[0].event_url) == ("Fest", "2026-07-03", "19:30 Uhr", "Halle", "Verein", "Text", "/e?x=1&y=2")
    stripe = box.replace("cVeka_box_eventDate", "cVeka_stripes_eventDateOdd")
    assert registry.eggenstein(pages(spark, stripe + stripe), "2026-01-01").count() == 1


def test_pages(spark):
    art = '<article class="teaser x"><h5 class="entry-header-teaser">Kurs</h5><a class="read-more" href="/k">m</a><div class="entry-content-teaser"><p>Am 03.07.2026 um 9 Uhr</p></div></article>'
    r = registry.workshop(pages(spark, art), "2026-01-01").first()
    assert (r.title, r.date_start, r.time_raw, r.event_url) == ("Kurs", "2026-07-03", "09:00", "/k")
    lines = "<p>03.07.26</p><p>Sommerfest</p><p>03.07.26</p><p>Sommerfest</p>"
    assert [x.title for x in registry.village(pages(spark, lines), "2026-01-01").collect()] == ["Sommerfest Büchig"]
    item = '<div class="item clearfix"><p>03.07.2026</p><p class="spendeart">Blutspende</p><div class="adresse"><strong>76297 Ort</strong><br>Halle<br>Str. 1<br><strong>14:00 - 19:00 Uhr</strong></div></div>'
    r = registry.blood(pages(spark, item + item), "2026-01-01").collect()
    assert len(r) == 2 and (r[0].location, r[0].time_raw, r[0].date_start) == ("76297 Ort, Halle, Str. 1", "14:00 - 19:00 Uhr", "2026-07-03")
    div = '<div class="event layout_teaser"><span class="date">{}</span><h2>{}</h2></div></div>'
    assert [x.title for x in registry.school(pages(spark, div.format("03.07.2026", "Fest") + div.format("04.07.2026", "Sommerferien")), "2026-01-01").collect()] == ["Fest"]
    row = "<tr><td>{}</td><td>19 Uhr</td><td>{}</td><td>Saal</td></tr>"
    assert [(x.title, x.date_start) for x in registry.forest_town(pages(spark, row.format("3. Juli 2026", "A") + row.format("01.01.2020", "B") + row.format("bald", "C")), "2026-01-01").collect()] == [("A", "2026-07-03")]
    feed = spark.createDataFrame([("<item><title>Turnier am 03.07.2026</title></item><item><title>Kreisklasse 04.07.2026</title></item><item><title>Alt 01.01.2026</title></item>",)], "body string")
    assert [x.date_start for x in registry.sport_club(feed, "2026-01-01").collect()] == ["2026-07-03"]


def test_rest_with_lookups(spark):
    one = lambda t, **k: json.dumps({"title": {"rendered": t}, "meta": {"start_date": "2026-07-03 19:30:00", "all_day": k.get("all_day", False)}, "stec_loc": k.get("loc"), "stec_org": [1], "content": {"rendered": "<p>d</p>"}, "link": "l"})
    events = spark.createDataFrame([(one("A &amp; B", loc=[2, 9, 1]),), (one("a &amp; b"),), (one("C", all_day=True),)], "body string").coalesce(1)
    names = spark.createDataFrame([(1, "Eins"), (2, "Zwei")], "id long, name string")
    out = {r.title: r for r in registry.regional_press(events, names, names).collect()}
    assert set(out) == {"A & B", "C"} and (out["A & B"].location, out["A & B"].organizer, out["A & B"].time_raw, out["C"].time_raw) == ("Zwei, Eins", "Eins", "19:30", "")


def test_generators_and_run(spark):
    assert registry.weekly_markets(spark, "2026-05-06").count() == 52
    cafe = registry.cafe_meetings(spark, "2026-07-01").collect()
    assert not any(r.date_start[5:7] in ("08", "09") for r in cafe if r.title == "Skattreff") and sum(r.title == "Witwenstammtisch" for r in cafe) == 12
    landed = {"buechigerleben": pages(spark, "<p>03.07.26</p><p>Fest</p>"), "meinstutensee": pages(spark, '<script type="application/ld+json">{"@type": "Event", "name": "N", "startDate": "2026-07-03"}</script>')}
    out = registry.run_all(landed, "2026-01-01").orderBy("ord").collect()
    assert [(r.source_url, r.title) for r in out] == [("meinstutensee", "N"), ("buechigerleben", "Fest")] and list(SOURCES)[:2] == ["official", "eggenstein"]
    club = registry.clubs([landed_rows for landed_rows in [spark.createDataFrame([("A", "2026-01-01", "Forbach"), ("B", "", "x"), ("C", "2026-01-01", None)], "title string, date_start string, location string")]])
    assert [r.title for r in club.collect()] == ["C"]


def test_helpers(spark):
    from almanac.sources import parsers

    html = "<h3>Sommerfest 03.07.2026</h3><p>um 18 Uhr</p><h3>Alt, 1. Januar 2020</h3><p>vorbei</p><h3>Ohne</h3>"
    out = parsers.heading_events(pages(spark, html), r"<h3>[^<]*</h3>", "2026-01-01", 40).collect()
    assert [(r.title, r.date_start, r.time_raw) for r in out] == [("Sommerfest", "2026-07-03", "18:00")]
    rows = spark.createDataFrame([(0, 0, "Gruppe", "2026-01-02", "2026-01-01", "Saal"), (0, 1, "Fest", "2026-01-02", "2026-01-03", "")], "page_id long, pos int, title string, date_start string, date_end string, location string")
    assert [r.title for r in parsers.titled_by_place(rows, ["gruppe"]).orderBy("pos").collect()] == ["Gruppe (Saal)", "Fest"]
    assert [r.date_end for r in parsers.ends_after_start(rows).orderBy("pos").collect()] == [None, "2026-01-03"]
    cards = rows.withColumn("location", rows["title"])
    assert [(r.title, r.location) for r in parsers.with_cards(rows, cards, ["location"]).collect()] == [("Gruppe", "Gruppe")]
    assert parsers.upcoming(rows, "2026-01-02").count() == 2 and parsers.upcoming(rows, "2026-01-02", False).count() == 0


def test_card_sites(spark):
    box = '<div class="ec-item-box x"><h3 class="title">Gottesdienst</h3><p class="ec-date">3.7.2026 19:30</p><p class="address">Saal</p><a href="/x?zm.sid=1">m</a></div>'
    r = SOURCES["cvjm_graben_neudorf"](pages(spark, box + box + '<div class="ec-item-box"><h3 class="title">Ohne Datum</h3></div>'), "2026-01-01").collect()
    assert [(x.title, x.date_start, x.time_raw, x.location, x.organizer, x.event_url) for x in r] == [("Gottesdienst (Saal)", "2026-07-03", "19:30", "Saal", "CVJM Graben-Neudorf", "/x")]
    row = '<div class="views-row"><div class="views-field-title"><a href="/a">A</a></div><div class="views-field-field-eventdate"><span content="2026-07-03T18:00:00+02:00">Fr</span></div></div>'
    assert [(x.title, x.date_start, x.time_raw) for x in SOURCES["bretten"](pages(spark, row), "2026-01-01").collect()] == [("A", "2026-07-03", "18:00")]
    rec = '<div class="hwveranstaltung__record"><h3 class="hw_record__title"><span>Fest</span></h3><div class="hw_record__date">03.07.2026 bis 05.07.2026</div><div class="hw_record__organizer">V</div><div class="hw_record__simpleLocation">Ort</div></div>'
    x = SOURCES["graben_neudorf"](pages(spark, rec), "2026-01-01").first()
    assert (x.title, x.date_start, x.date_end, x.organizer, x.location) == ("Fest", "2026-07-03", "2026-07-05", "V", "Ort")


def test_more_sites(spark):
    li = "<ul><li>Sa., 3.7. MARKTTAG ab 10:00 Uhr | Rathaus</li><li>Sa., 3.7. ZWEITER</li><li>nichts</li></ul>"
    assert [(x.title, x.date_start, x.time_raw, x.location) for x in SOURCES["gewerbeverein"](pages(spark, li), "2026-01-01").collect()] == [("MARKTTAG", "2026-07-03", "10:00", "Rathaus")]
    tr = "<table><tr><td>03.07.2026 @ 10:30</td><td>01.07.2026</td><td>Spiel</td></tr><tr><td>03.07.2020</td><td></td><td>Alt</td></tr></table>"
    assert [(x.title, x.date_start, x.date_end, x.time_raw) for x in SOURCES["svstaffort"](pages(spark, tr), "2026-01-01").collect()] == [("Spiel", "2026-07-03", None, "10:30")]
    tr = "".join(f"<tr><td>{d}</td><td>Einsatz</td><td></td></tr>" for d in ("03.07.2026 bis 05.07.2026", "04.07.2026", "06.07.2026", "07.07.2026"))
    assert sorted(x.date_start for x in SOURCES["tsg_blankenloch"](pages(spark, tr), "2026-01-01").collect()) == ["2026-07-03", "2026-07-06"]
    post = '<h2 class="entry-title"><a href="/p" rel="bookmark">Hoffest am 3. Juli 2026</a></h2><div class="entry-content">um 18 Uhr</div>'
    assert [(x.date_start, x.time_raw) for x in SOURCES["rintheim"](pages(spark, post), "2026-01-01").collect()] == [("2026-07-03", "18:00")]
