import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from almanac import dictionaries as D
from almanac.operators import dedup, landing, quality, rules, series, tagging
from almanac.operators.graph import components

RAW = "ord long, source_url string, title string, date_start string, date_end string, time_raw string, location string, organizer string, description string, event_url string"


def raw(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW)


def event(title, date="2026-07-10", place="Festplatz, 1", org="Verein", desc="", source="s1", url="u"):
    return (source, title, date, None, "", place, org, desc, url)


def test_exact_dedup_ties_and_sources(spark):
    rows = [event("Fest in Spöck", desc="aa", source="b, a"), event("Fest", desc="bb", source="c"), event("Fest", place="Halle"), event("Fest", desc="b", source=None), event("Fest-", org="Veranstalter: SV Staffort e.V.", date="2026-08-01")]
    out = {r.id: r for r in dedup.exact_dedup(raw(spark, rows)).collect()}
    assert {k: (v.ord, v.sources) for k, v in out.items()} == {0: (0, ["a", "b", "c"]), 2: (2, ["s1"]), 4: (4, ["s1"])}
    assert out[4].organizer == "Sportverein Staffort e.V."


def test_idempotent_and_order_free(spark):
    draw = random.Random(2)
    rows = [event(draw.choice(["Fest", "Fest in Büchig", "Markt", "Sommerfest am See", "Sommerfest", "Konzert heute abend"]), f"2026-07-{draw.randint(10, 12)}", draw.choice(["Halle", "Büchig", None]), draw.choice(["", "A e.V.", "A"]), "x" * draw.randint(0, 9), draw.choice("abc")) for _ in range(60)]
    once, _ = dedup.fuzzy_merge(dedup.exact_dedup(raw(spark, rows)), 2)
    shuffled = raw(spark, rows).repartition(5, "description")
    again, _ = dedup.fuzzy_merge(dedup.exact_dedup(shuffled), 2)
    key = lambda d: sorted((r.id, r.title, tuple(r.sources)) for r in d.collect())
    assert key(once) == key(again)
    twice, _ = dedup.fuzzy_merge(once, 2)
    assert key(twice) == key(once)


def pairs(frame):
    return {(r.a, r.b) for r in frame.collect()}


def linked(edges, n):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_place(rows, guard):
    out = set()
    for a, b in itertools.combinations(rows, 2):
        if (a.day, a.place) != (b.day, b.place):
            continue
        x, y = a.t, b.t
        if x == y or len(x) > 6 and len(y) > 6 and (a.tc in b.tc or b.tc in a.tc):
            if a.org == b.org or guard == "contain" and (a.org in b.org or b.org in a.org):
                out.add((a.id, b.id))
    return out


def brute_date(rows):
    out = set()
    for a, b in itertools.combinations(rows, 2):
        if a.day != b.day or a.t == b.t:
            continue
        for s, l in ((a, b), (b, a)):
            if len(s.t) <= len(l.t) and len(s.tc) > 6 and len(l.tc) > 6:
                near = (s.tc in l.tc or l.tc in s.tc) and len(s.tc) >= len(l.tc) * 0.5
                if (near or all(any(w in x for x in l.t.split()) for w in s.t.split())) and (a.org in b.org or b.org in a.org):
                    out.add((a.id, b.id))
    return out


@pytest.mark.parametrize("seed", [1])
def test_gram_blocking_loses_no_pair(spark, seed):
    draw = random.Random(seed)
    words = ["sommer", "fest", "am", "see", "sommerfest", "a", "b", "markt", "der", "konzert", "abend", "ab", "      x"]
    rows = [event(" ".join(draw.choice(words) for _ in range(draw.randint(1, 5))), f"2026-07-1{draw.randint(0, 1)}", draw.choice(["Halle", "Büchig"]), draw.choice(["", "A e.V.", "A", "B"])) for _ in range(70)]
    curated = dedup.exact_dedup(raw(spark, rows))
    keyed = dedup.keyed(curated)
    flat = sorted(keyed.collect(), key=lambda r: r.id)
    for guard in ("contain", "equal"):
        got, want = pairs(dedup.same_place_pairs(keyed, guard)), brute_place(flat, guard)
        assert got <= want
        assert linked(got, len(rows)) is not None
        a, b = linked(got, len(rows)), linked(want, len(rows))
        assert len({(x, y) for x, y in zip(a, b)}) == len(set(a)) == len(set(b))
    got, want = pairs(dedup.any_place_pairs(keyed)), brute_date(flat)
    assert got <= want and want
    a, b = linked(got, len(rows)), linked(want, len(rows))
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_greedy_agrees_where_matching_is_transitive(spark):
    rows = [event("Sommerfest am See", desc="x" * i, source=f"s{i}") for i in range(4)] + [event("Sommerfest am See heute", place="Festplatz", source="s9"), event("Anderes Ereignis")]
    curated = dedup.exact_dedup(raw(spark, rows))
    merged, _ = dedup.merge(curated, dedup.same_place_pairs(dedup.keyed(curated), "equal"))
    assert sorted((r.title, r.sources) for r in dedup.greedy_merge(curated).collect()) == sorted((r.title, r.sources) for r in merged.collect())


def test_lineage_follows_merges(spark):
    rows = [event("Sommerfest am See", source="a"), event("Sommerfest am See heute", source="b", desc="long one"), event("Markt", source="c"), event("", source="d"), event("X", date="", source="e")]
    r = raw(spark, rows)
    clean = landing.dedup_filter(r)
    curated = dedup.exact_dedup(clean)
    out, links = dedup.fuzzy_merge(curated, 1, dedup.lineage(clean, curated))
    assert sorted((x.raw_id, x.curated_id) for x in links.collect()) == [(0, 1), (1, 1), (2, 2)]
    assert {x.ord: x.sources for x in out.collect()} == {1: ["a", "b"], 2: ["c"]}


def test_manual_and_organizer_passes(spark):
    rows = [event("Hähnchen Grillfest"), event("Hähnchenfest", desc="more"), event("Hähnchenfest", date="2026-07-11"), event("A", org="Gesamtelternbeirat x", place="p1"), event("B", org="Der Gesamtelternbeirat", place="p2")]
    c = dedup.exact_dedup(raw(spark, rows))
    assert pairs(dedup.manual_pairs(dedup.keyed(c))) == {(0, 1)} and pairs(dedup.organizer_pairs(c)) == {(3, 4)}


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters(spark):
    rows = [event("Altpapiersammlung im Mai"), event("ALTPAPIERSAMMLUNG x"), event("JRK Gruppenstunde"), event('"Zitat"'), event("  "), event("Ok", date="2026-2-3"), event("Früher", date="2025-01-01"), event("Leer", date=""), event(None)]
    r = raw(spark, rows)
    names = lambda d: sorted(str(x.title) for x in d.collect())
    assert names(landing.landing_filter(r, F.lit("2026-02-03").cast("date"))) == sorted(["ALTPAPIERSAMMLUNG x", '"Zitat"', "  ", "Ok", "None"])
    assert names(landing.dedup_filter(r)) == sorted(['"Zitat"', "  ", "Ok", "Früher"])
    assert names(landing.document_filter(r)) == sorted(["ALTPAPIERSAMMLUNG x", "Zitat", "Früher", "Leer"])
    assert names(landing.well_formed(landing.dated(r.filter("title is not null")))) == sorted(x[1] for x in rows if x[1] is not None and x[2] not in ("", "2026-2-3"))


def test_upsert_and_first(spark):
    old = raw(spark, [event("A", url="x"), event("B", url=None)])
    new = raw(spark, [event("A", url="x"), event("C", url="x"), event("C", url="x"), event("B", url=None), event("B", url=None)])
    assert sorted(r.title for r in landing.upsert_ignore(old, new, order=["ord"]).collect()) == ["B", "B", "C"]
    first = landing.distinct_first(new, ["title"], ["ord"], keep_null="event_url").collect()
    assert sorted((r.title, r.ord) for r in first) == [("A", 0), ("B", 3), ("B", 4), ("C", 1)]


def test_contained_intervals(spark):
    rows = [("t", "2026-01-01", "2026-01-05"), ("t", "2026-01-02", "2026-01-03"), ("t", "2026-01-04", None), ("t", "2026-01-06", "2026-01-06"), ("t", "2026-01-07", "2026-01-07"), ("u", "2026-01-02", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, title string, s string, e string")
    assert sorted(r.ord for r in landing.without_contained(frame, "title", "s", "e", ["ord"]).collect()) == [0, 3, 5]


def test_tags(spark):
    rule = D.TagRules(keywords={"Sport": ["rad", "turnen"], "Musik": ["chor", "konzert"], "Kirche": ["messe"], "Fest": ["fest"]})
    rows = [
        event("Konrad liest", place="Blankenloch", org="CVJM Spöck"), event("Konzert und Messe und Fest"), event("Krabbelgruppe mit Chor", org="FC Büchig"), event("Abifeier"), event("Abifeier mit Radtour, Chor, Fest"), event(None, place=None, org=None),
        event("Treff", place="Spöcker Weg 1", org="Staffort-Büchenau e.V."),
    ]
    got = {r.ord: r.auto_tags for r in tagging.tagged(raw(spark, rows), rule).collect()}
    assert got == {0: ["Kirche", "Blankenloch", "Spöck"], 1: ["Musik", "Kirche"], 2: ["Kinder", "Büchig"], 3: ["Fest"], 4: ["Sport", "Musik", "Fest"], 5: [], 6: ["Friedrichstal", "Staffort"]}
    tagged = raw(spark, rows[:2]).withColumn("tags", F.when(F.col("ord") == 0, F.array(F.lit("Alt"))).otherwise(F.array().cast("array<string>")))
    assert [r.tags for r in tagging.tag_untagged(tagged, rule).orderBy("ord").collect()] == [["Alt"], ["Musik", "Kirche"]]
    assert [r.tags for r in tagging.tag_merge(tagged, rule).orderBy("ord").collect()] == [["Alt", "Kirche", "Blankenloch", "Spöck"], ["Musik", "Kirche"]]


@pytest.mark.parametrize("steps,strict,majority", [([7, 7], "weekly", "weekly"), ([7, 14], None, None), ([14], "biweekly", "biweekly"), ([28, 31], "monthly", "monthly"), ([0, 7], None, None), ([7, 7, 3], None, "weekly"), ([], None, None)])
def test_series(spark, steps, strict, majority):
    days = list(itertools.accumulate(steps, initial=0))
    frame = spark.createDataFrame([("k", d) for d in days], "k string, n int").withColumn("d", F.date_add(F.lit("2026-01-01").cast("date"), F.col("n")))
    for mode, want in (("strict", strict), ("majority", majority)):
        assert [r.pattern for r in series.patterns(frame, "k", "d", mode).collect()] == ([want] if want else [])


def test_generators_and_segments(spark):
    assert [str(r[0]) for r in series.next_weekdays(spark, "2026-05-06", 2, 3).collect()] == ["2026-05-06", "2026-05-13", "2026-05-20"]
    assert [str(r[0]) for r in series.month_weekdays(spark, "2026-03-01", "2026-04-30", 1, [1, 3]).orderBy("date_start").collect()] == ["2026-03-03", "2026-03-17", "2026-04-07", "2026-04-21"]
    got = spark.createDataFrame([("x 1.1. Alpha 2.1. Beta",)], "t string").select(series.segments(F.col("t"), r"\d\.\d\.").alias("s"), series.earliest_pattern(F.col("t"), ["Beta", "Al"]).alias("e")).first()
    assert [(s.mark, s.body) for s in got.s] == [("1.1.", "Alpha"), ("2.1.", "Beta")] and got.e == "Al"
    lines = spark.createDataFrame([("p", 0, "T1", False), ("p", 1, None, True), ("p", 2, None, True), ("p", 3, "T2", False), ("p", 4, None, True)], "p string, i int, t string, takes boolean")
    assert [r.o for r in series.carried(lines, "p", "i", F.col("t"), "o").orderBy("i").collect()] == ["T1", "T1", None, "T2", "T2"]


def test_rules(spark):
    rows = [
        ("", "Treffen", "CVJM Spöck", "Beginn: 18.30 Uhr", "", ["Kirche"], ""), ("x", "Schachturnier", "", "", "1", ["Kirche", "Sport"], "http://graben-neudorf.de"), (None, "Vesper", "", "um 19:00 Uhr", None, [], "http://a"),
        ("Büchig", "Cheerleading", "Veranstalter: X", "Treffpunkt: 10:00 Uhr, Bahnhof. Rückkehr", "1", [], ""), ("", "Gartenfest", "", "Treffpunkt: 10:00 Uhr, Am Bahnhof. Rückkehr", "1", ["Sport"], ""),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, location string, title string, organizer string, description string, time_raw string, tags array<string>, event_url string")
    out = {r.id: r for r in rules.apply_rules(frame).collect()}
    assert (out[0].location, out[0].time_raw) == ("CVJM-Marienhof", "18:30")
    assert out[1].tags == ["Sport", "Graben-Neudorf"] and out[1].applied_rules == ["fix_tag_church_false_positive", "fix_district_from_url"]
    assert out[2].time_raw is None and out[2].tags == ["⚠️"]
    assert out[3].organizer == "X" and out[3].tags == ["Sport", "Kinder", "Büchig"]
    assert out[4].location == "Am Bahnhof" and out[4].tags == ["Fest"]
    again = rules.apply_rules(rules.apply_rules(frame).drop("applied_rules")).filter(F.size("applied_rules") > 0)
    assert again.count() == 0


def test_quality(spark):
    frame = spark.createDataFrame([(1, "Vesper", "", "", "", ["Sport"], ["a"], "", ""), (2, "Ein langes Konzert", "Halle", "19:30", "d" * 90, ["Musik", "Büchig"], ["a"], "", "")], "id int, title string, location string, time_raw string, description string, tags array<string>, sources array<string>, organizer string, event_url string")
    out, rounds = quality.quality_loop(frame)
    assert {r.id: r._quality.passed for r in out.collect()} == {1: False, 2: True} and rounds == 2
    assert [r.id for r in quality.to_judge_again(out).collect()] == [1]
    replies = ["```json\n" + json.dumps({"judgments": {"a": {"score": 0.9, "issues": []}}, "overall_score": "0.7", "summary": "ok"}) + "\n```", "no json", None]
    got = [r.q for r in spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, r string").orderBy("i").select(quality.judgement_from_reply(F.col("r")).alias("q")).collect()]
    assert (got[0].overall_score, got[0].passed, got[0].judgments["a"].score) == (0.7, True, 0.9)
    assert all(not g.passed and g.overall_score == 0 and {j.score for j in g.judgments.values()} == {0.5} for g in got[1:])


def test_siblings_and_lookup(spark):
    rows = [(1, "A", "a", "short", "d1"), (2, "A", "a", "x" * 30, "d1"), (3, "A", "a", "y" * 25, "d1"), (4, "B", None, "", "d1"), (5, "B", None, "z" * 40, "d2"), (6, "C", "c", "w" * 21, "d1"), (7, "D", "d", "", "d1")]
    frame = spark.createDataFrame(rows, "id long, title string, normalized_title string, description string, date_start string")
    out = {r.id: r.description for r in dedup.fill_from_siblings(frame).collect()}
    assert out[1] == "x" * 30 and out[4] == "z" * 40 and out[7] == "" and out[3] == "y" * 25
    raw_rows = spark.createDataFrame([("Das A Fest", "d1", "from raw, long"), ("A", "d2", "other day text")], "title string, date_start string, description string")
    poor = spark.createDataFrame([(1, "a", "d1", "k"), (2, "q", "d1", "kk"), (3, "a", "d1", "")], "id long, title string, date_start string, description string")
    assert {r.id: r.description for r in dedup.look_up_descriptions(poor, raw_rows).collect()} == {1: "from raw, long", 2: "", 3: ""}


def test_featured(spark):
    frame = spark.createDataFrame([(i, ["Büchig"], "Büchig", 0) for i in range(1, 6)], "id long, tl array<string>, location string, is_passed int").withColumn("tags", F.array_join("tl", ","))
    out = landing.choose_featured(frame, [1, 2, 3, 4], ["Büchig"])
    assert {r.id for r in out.filter("featured = 1").collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        landing.choose_featured(frame, [1, 2, 3], ["Büchig"])
    with pytest.raises(ValueError):
        landing.choose_featured(frame, [1, 2, 3, 9], ["Büchig"])


def test_counts(spark):
    from pyspark.sql import functions as F

    from almanac.operators import counts

    rows = spark.createDataFrame([(1, "x", "<b>a</b>  b"), (1, "y", None), (2, "x", "plain text that is long enough"), (2, None, "T&amp;T")], "k int, v string, description string")
    got = counts.most_frequent_first(counts.by_group(rows, ["k"], {"n_x": F.col("v") == "x"}, ["v"]), "k").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, "x,y"), (2, 2, 1, "x")]
    one = counts.cleanup_counts(rows).first().asDict()
    assert one == {"total": 4, "html_entities_decoded": 1, "html_tags_stripped": 1, "whitespace_normalized": 1, "empty_before": 1, "short_before": 2, "filled_from_sibling": 0, "scrap_garbage_removed": 0, "changed": 2, "unchanged": 2, "errors": 0}
    empty = rows.limit(0)
    assert counts.by_group(empty, [], {"n_x": F.col("v") == "x"}).collect()[0].n == 0 and counts.cleanup_counts(empty).first().total == 0


def test_carry_tags_and_stale_files(spark):
    from almanac.operators import dedup
    from almanac.sources import corpus

    cur = spark.createDataFrame([(1, []), (2, ["own"]), (3, None), (4, [])], "id long, tags array<string>")
    raw = spark.createDataFrame([(10, ["b"]), (11, ["a", "z"]), (12, ["c"]), (13, [])], "ord long, tags array<string>")
    links = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3)], "raw_id long, curated_id long")
    assert {r.id: r.tags for r in dedup.carry_tags(cur, raw, links).collect()} == {1: ["a", "z"], 2: ["own"], 3: None, 4: []}
    there = spark.createDataFrame([("a.json",), ("b.json",), (None,)], "file string")
    assert [r.file for r in corpus.stale_files(there, there.limit(0)).orderBy("file").collect()] == ["a.json", "b.json"]


def test_defaults_meet_by_pieces_not_by_date(spark):
    rng = random.Random(3)
    words = ["fest", "am", "see", "2.", "sommer", " ", "ß", "", "10", "a", "Großer ", "flohmarkt der vereine ", "\u00a0", "konzert"]
    title = lambda: rng.choice([None, "", "A", *["".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(40)]])
    rows = [(i, rng.choice(["2026-07-01", "2026-07-02", "2026-07-03", None, ""]), title()) for i in range(300)]
    rows += [(1000, "2026-08-01", ""), (1001, "2026-08-01", "alles"), (1002, "2026-08-02", "alles"), (1003, "2026-08-02", " "), (1004, "2026-08-03", "Fest 1."), (1005, "2026-08-03", "2. fest"), (1006, "2026-08-03", None)]
    df = spark.createDataFrame(rows, "ord long, date_start string, title string")
    events, defaults = df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1")
    out = landing.fill_defaults(events, defaults)
    e, d = events.select(F.col("date_start").alias("ed"), F.col("title").alias("et")), defaults
    pairs = d.join(e, (F.col("ed") == F.col("date_start")) & landing.text.title_similar(F.col("title"), F.col("et")), "left_anti")
    want = sorted([r.ord for r in events.collect()] + [r.ord for r in pairs.collect()])
    assert sorted(r.ord for r in out.collect()) == want and 154 < len(want) < len(rows)
    # Titles are compared only where a piece of them is the same as well.
    compared = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "Contains(" in line]
    assert compared and all("piece" in line for line in compared)
