import json

from pyspark.sql import functions as F

from almanac.plans.curation import curate_v1, curate_v2
from almanac.sources import corpus, parsers
from almanac.storage import materialize
from almanac.streaming.landing import land_stream
from tests.test_operators import event, raw


def pages(spark, *html):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_blocks(spark):
    layout = parsers.Layout(r'<div class="e">(.*?)</div>', {"title": r"<a[^>]*>([^<]+)</a>", "event_url": r'href="([^"]*)"', "date_start": r"</a>,\s*([\d.]+)"}, constants={"organizer": "O"}, require=("title",))
    html = '<div class="e"><a href="/x?a=1&amp;b=2">Fest &amp; Markt</a>, 3.7.26</div><div class="e"><a href="/y"> Zwei </a>, bald</div><div class="e">nichts</div>'
    out = parsers.html_blocks(pages(spark, html, None), layout).collect()
    assert [(r.title, r.event_url, r.date_start, r.organizer) for r in out] == [("Fest & Markt", "/x?a=1&b=2", "2026-07-03", "O"), ("Zwei", "/y", "", "O")]


def test_json_ld(spark):
    one = {"@type": "Event", "name": "A", "startDate": "2026-05-01T19:30:00+02:00", "location": {"name": "Halle"}, "organizer": [{"name": "Verein"}], "description": "<p>x &amp; y</p>", "url": "u"}
    graph = {"@graph": [{"@type": "Event", "name": "B", "startDate": "2026-5-2"}, {"@type": "Place"}]}
    html = "".join(f'<script type="application/ld+json">{s}</script>' for s in (json.dumps(one), "{broken", json.dumps(graph), json.dumps({"@type": "Event", "name": "no date"})))
    out = {r.title: r for r in parsers.json_ld(pages(spark, html)).collect()}
    assert set(out) == {"A", "B"} and (out["A"].date_start, out["A"].time_raw, out["A"].location, out["A"].organizer, out["A"].description) == ("2026-05-01", "19:30", "Halle", "Verein", "x & y")
    assert out["B"].date_start == "2026-05-02"


def test_rest_rss_tables_lines(spark):
    body = {"events": [{"title": "A &amp;amp; B", "start_date": "2026-05-01 19:30:00", "venue": [{"venue": "Halle", "city": "Ort"}], "organizer": [{"organizer": "x"}, {"organizer": "y"}], "description": "<b>d</b>"}, {"title": "C", "start_date": "2026-05-02", "venue": {"venue": "V"}}]}
    out = parsers.rest_events(spark.createDataFrame([(json.dumps(body),)], "body string")).orderBy("pos").collect()
    assert [(r.title, r.date_start, r.time_raw, r.location, r.organizer, r.description) for r in out] == [("A & B", "2026-05-01", "19:30", "Halle, Ort", "x; y", "d"), ("C", "2026-05-02", "", "V", "", "")]
    feed = "<rss><item><title><![CDATA[Fest &amp; Co]]></title><link>http://x/?zm.sid=3</link><pubDate>Fri, 05 Jun 2026 10:00:00 +0200</pubDate></item><item><title>Training</title></item></rss>"
    items = parsers.rss_items(spark.createDataFrame([(feed,)], "body string"), skip="Training").collect()
    assert [(r.title, r.event_url, r.date_start) for r in items] == [("Fest & Co", "http://x/", "2026-06-05")]
    table = parsers.table_rows(pages(spark, "<table><tr><td>a</td><td><b>b</b></td></tr><tr><td>only</td></tr></table>"), ["x", "y"]).collect()
    assert [(r.x, r.y) for r in table] == [("a", "b")]
    lines = "<p>03.07.26</p><p>19:30 Uhr, Halle</p><p>Fest</p><p>04.07.26</p><p>Markt</p><script>05.07.26</script>"
    assert [(r.date_start, r.time_raw, r.title) for r in parsers.dated_lines(pages(spark, lines)).orderBy("pos").collect()] == [("2026-07-03", "19:30 Uhr", "Fest"), ("2026-07-04", "", "Markt")]
    assert [r.body for r in parsers.windows_after(pages(spark, "H1 abc H2 defgh"), r"H\d", 4).orderBy("pos").collect()] == [" abc", " def"]


def test_corpus_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/events"
    frame = corpus.named(spark.createDataFrame([(1, "Größtes Fest", "2026-07-10"), (2, "größtes fest", "2026-07-10"), (3, "!!", None)], "id long, title string, date_start string").withColumn("sources", F.array(F.lit("s"))))
    for c in ("date_end", "time_raw", "location", "organizer", "description", "event_url"):
        frame = frame.withColumn(c, F.lit("")) if c != "date_end" else frame.withColumn(c, F.lit(None).cast("string"))
    frame = frame.withColumns({"tags": F.array(F.lit("Fest")), "recurring_group_id": F.lit(None).cast("long"), "is_passed": F.lit(0), "featured": F.lit(0)})
    written = corpus.write_corpus(frame, folder)
    assert {(r.file, r.changed) for r in written.collect()} == {("2026-07-10_groesstes-fest.json", True), ("2026-07-10_groesstes-fest_1.json", True), ("unknown_event.json", True)}
    assert corpus.write_corpus(frame, folder).filter("changed").count() == 0
    (tmp_path / "events" / "broken.json").write_text("{")
    back = materialize(corpus.read_corpus(spark, folder), "corpus")
    assert sorted(r.title for r in back.collect()) == ["!!", "Größtes Fest", "größtes fest"]
    assert corpus.remove_stale(spark, folder, written.filter("file <> 'unknown_event.json'")) == 2
    assert corpus.read_corpus(spark, folder).count() == 2
    report = corpus.change_report(back.filter("file <> 'unknown_event.json'"), back)
    assert "## Added: 1" in report and "## Removed: 0" in report
    pairs = spark.createDataFrame([(7, 99)], "old_id long, new_id long")
    events, leads = corpus.build_tables(back, f"file://{tmp_path}/db", pairs)
    one = events.first().id
    assert events.count() == 3 and leads.count() == 0
    _, leads = corpus.build_tables(back, f"file://{tmp_path}/db", spark.createDataFrame([(7, one), (9, one)], "old_id long, new_id long"))
    assert [tuple(r) for r in leads.collect()] == [(9, one)]
    assert corpus.restore_tables(spark, f"file://{tmp_path}/db/events", f"file://{tmp_path}/db").count() == 3
    raw_rows, curated, links = corpus.seed(back)
    assert (raw_rows.count(), links.count()) == (2, 2)


def test_stream_lands_each_key_once(spark, tmp_path):
    src, target = tmp_path / "in", f"file://{tmp_path}/raw"
    src.mkdir()
    schema = "source_url string, title string, date_start string, event_url string"
    row = lambda t, u="u": json.dumps({"source_url": "s", "title": t, "date_start": "2026-01-01", "event_url": u})
    (src / "1.json").write_text("\n".join([row("A"), row("A"), row("B")]))
    land_stream(spark, f"file://{src}", schema, target, f"file://{tmp_path}/cp").awaitTermination()
    (src / "2.json").write_text("\n".join([row("A"), row("C")]))
    land_stream(spark, f"file://{src}", schema, target, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(target).collect()) == ["A", "B", "C"]


def test_pipelines(spark):
    rows = [event("Sommerfest am See", source="a", desc="lang"), event("Sommerfest am See heute", source="b"), event("Markt", date="2026-07-03"), event("Markt", date="2026-07-10"), event("Markt", date="2026-07-17"), event("Altpapiersammlung"), event("Alt", date="2020-01-01")]
    r = raw(spark, rows)
    out, links = curate_v1(r, "2026-07-01")
    got = {(x.title, x.date_start): x for x in out.collect()}
    assert len(got) == 5 and got["Sommerfest am See", "2026-07-10"].sources == ["a", "b"]
    assert got["Alt", "2020-01-01"].is_passed == 1 and len({x.recurring_group_id for k, x in got.items() if k[0] == "Markt"}) == 1
    assert links.count() == 6
    two = curate_v2(r.filter("ord <> 6"), "2026-07-01", previous=raw(spark, [event("Von gestern", source="still")])).collect()
    assert {x.title for x in two} == {"Sommerfest am See", "Markt", "Von gestern"}


def test_every_query_runs_and_matches_sql(spark):
    import duckdb
    import os

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    from almanac.queries import QUERIES, SQL

    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{p}')")
    assert entry.entry(spark).count() > 0
    plain = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    for name, f in QUERIES.items():
        frame = f(spark, sf)
        cols = sorted(frame.columns)
        got = plain(tuple(r) for r in frame.select(cols).collect())
        if name in SQL:
            assert got == plain(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()), name


def differs_from_sql(spark, tmp_path, name, texts):
    """Rows of a query over documents of these texts, and of its SQL, that the other lacks."""
    import duckdb

    from almanac.queries import QUERIES, SQL

    rows = [(i, t, "de", "src1", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    frame = QUERIES[name](spark, str(tmp_path))
    got, want = {tuple(r) for r in frame.collect()}, set(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({SQL[name]})").fetchall())
    return got - want, want - got


def test_file_names_are_whole_where_umlauts_are_written_out(spark, tmp_path):
    assert differs_from_sql(spark, tmp_path, "k04_file_names", ["üä " * 13 + "ü\nmehr", "ä" * 40, "ä" * 39 + "ö", "Fest", "!", None]) == (set(), set())
    events = spark.createDataFrame([(1, "ä" * 40, "2026-07-10"), (2, "ä" * 31, "2026-07-10")], "id long, title string, date_start string")
    assert {r.file for r in corpus.named(events).collect()} == {f"2026-07-10_{'ae' * 30}.json", f"2026-07-10_{'ae' * 30}_1.json"}
    assert {r.file for r in corpus.named(events, most=None).collect()} == {f"2026-07-10_{'ae' * 40}.json", f"2026-07-10_{'ae' * 31}.json"}


def test_parts_of_addresses_and_dates_are_no_times(spark, tmp_path):
    from almanac.operators import rules

    texts = ["", "der von 23.83.99.226 er", "die von 69.214.7.8 und von 12.05.2026", "10.30 - 12:00 im Haus", "von 1.2.3.4 her, 9:15-10:00", "Beginn: 18.30.7"]
    assert differs_from_sql(spark, tmp_path, "q02_time_rule", texts) == (set(), set())
    told = {"von 10.20.30.40, von 18.30 bis 20": "18:30", "Beginn: 9:15.": "9:15", "19.30 Uhr": "19:30", "von 14:00 bis 17:00 Uhr": "17:00", "von 12.05.2026": "", "von 8.15": "8:15", "10:00 - 12:00": "10:00", "Beginn 7.30-8.30": "7:30"}
    frame = spark.createDataFrame([(k, "") for k in told], "description string, time_raw string").withColumn("tags", F.array().cast("array<string>"))
    assert {r.description: r.time_raw for r in rules.apply_rules(frame, ["fix_time_in_description"]).collect()} == told
