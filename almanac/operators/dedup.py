"""Entity resolution: exact keys, fuzzy passes inside date blocks, merging with lineage.

Fuzzy predicates are containments. Instead of all pairs of a block, the shorter title
is posted under one gram and the longer under all of its own, which loses no pair: a
text can only contain another if it contains that one's grams. So a block may hold a third
of all rows and still only rows that share a rare piece of text meet.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from almanac import dictionaries as D
from almanac.functions import text
from almanac.operators.graph import components
from almanac.storage import materialize

#: Letters of a gram that titles are matched through.
GRAM = 4


def exact_key(kind: str = "normal") -> list[Column]:
    """``normal``: normalized title, date, place before the comma. ``cased``: the older title key."""
    title = text.normalize_title(F.col("title")) if kind == "normal" else text.title_key_cased(F.col("title"))
    return [title.alias("k_title"), text.empty(F.col("date_start")).alias("k_date"), text.normalize_location(F.col("location")).alias("k_place")]


def longest(columns: Sequence[str], order: str, description: str = "description") -> Column:
    """Aggregate: the row with the longest description, the first of them in order."""
    return F.max_by(F.struct(*columns), F.struct(F.length(text.empty(F.col(description))), -F.col(order)))


def exact_dedup(raw: DataFrame, order: str = "ord", kind: str = "normal", source: str = "source_url") -> DataFrame:
    """One row for each key: the columns of the row with the longest description, all sources in order, the organizer clean, and the first ``ord`` of the group as ``id``."""
    keep = [c for c in raw.columns if c != source]
    parts = F.transform(F.split(text.empty(F.col(source)), ","), text.strip)
    grouped = raw.withColumns({k: c for k, c in zip(("k_title", "k_date", "k_place"), exact_key(kind))}).groupBy("k_title", "k_date", "k_place").agg(
        longest(keep, order).alias("best"), F.min(order).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts)))).alias("sources")
    )
    out = grouped.select("id", F.col("k_title").alias("normalized_title"), "best.*", F.filter("sources", lambda s: s != "").alias("sources"))
    return out.withColumn("organizer", text.clean_organizer(F.col("organizer")))


def legacy_dedup(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Group by trimmed lower-case title, date and place; the first row stands for the group, distinct sources are listed in order."""
    title = F.lower(F.trim(F.col("title")))
    keep = ["title", "date_end", "time_raw", "organizer", "description", "event_url"]
    return raw.groupBy(title.alias("k_title"), text.empty(F.col("date_start")).alias("date_start"), text.empty(F.col("location")).alias("location")).agg(
        F.min_by(F.struct(*keep), F.col(order)).alias("r"), F.array_join(F.array_sort(F.collect_set("source_url")), ",").alias("sources")
    ).select("r.*", "date_start", "location", "sources")


def lineage(raw: DataFrame, curated: DataFrame, raw_id: str = "ord", source: str = "source_url") -> DataFrame:
    """``raw_id, curated_id, dedup_round, source``: each raw row and the curated row with its key; the last one where several have it."""
    keys = ["k_title", "k_date", "k_place"]
    named = curated.withColumns(dict(zip(keys, exact_key()))).groupBy(*keys).agg(F.max("id").alias("curated_id"))
    rows = raw.filter((text.empty(F.col("title")) != "") & (text.empty(F.col("date_start")) != "")).withColumns(dict(zip(keys, exact_key())))
    return rows.join(named, keys).select(F.col(raw_id).alias("raw_id"), "curated_id", F.lit(1).alias("dedup_round"), F.col(source).alias("source"))


def restore_attributes(new: DataFrame, old: DataFrame, columns: Sequence[str] = ("tags", "recurring_group_id", "featured")) -> DataFrame:
    """The old table's values where it has the row's key and they say something."""
    keys = ["k_title", "k_date", "k_place"]
    was = old.withColumns(dict(zip(keys, exact_key()))).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col("id")).alias("__old"))
    out = new.withColumns(dict(zip(keys, exact_key()))).join(was, keys, "left")
    for c in columns:
        kind = old.schema[c].dataType.simpleString()
        value = F.col(f"__old.{c}")
        says = F.size(value) > 0 if kind.startswith("array") else value != "" if kind == "string" else value != 0
        out = out.withColumn(c, F.when(says, value).otherwise(F.col(c) if c in new.columns else F.lit(None).cast(kind)))
    return out.drop(*keys, "__old")


def carry_tags(curated: DataFrame, raw: DataFrame, links: DataFrame) -> DataFrame:
    """Tags of a linked raw row, the smallest as text, where the curated row has none."""
    found = links.join(raw.select(F.col("ord").alias("raw_id"), F.col("tags").alias("__t")).filter(F.size("__t") > 0), "raw_id").groupBy(F.col("curated_id").alias("id")).agg(F.min_by("__t", F.array_join("__t", ",")).alias("__t"))
    none = F.col("tags").isNull() | (F.size("tags") == 0)
    return curated.join(found, "id", "left").withColumn("tags", F.when(none & F.col("__t").isNotNull(), F.col("__t")).otherwise(F.col("tags"))).drop("__t")


# --- fuzzy passes -------------------------------------------------------------------


def _grams(c: Column, size: int = GRAM) -> Column:
    """Distinct pieces of ``size`` letters; the whole text where it is shorter."""
    n = F.length(c)
    return F.when(n < size, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(c, i, F.lit(size)))))


def _one_gram(c: Column, size: int = GRAM) -> Column:
    """One piece of a text, by the smallest hash: alike texts choose alike, common pieces are chosen no more than others."""
    return F.element_at(F.array_sort(F.transform(_grams(c, size), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), 1)["g"]


def compatible(a: Column, b: Column, guard: str) -> Column:
    """Whether two organizer keys may merge: ``contain`` (one in the other, the empty one in all) or ``equal``."""
    return a == b if guard == "equal" else text.either_contains(a, b)


def keyed(df: DataFrame) -> DataFrame:
    """``id`` with the keys that the passes read."""
    title = text.normalize_title(F.col("title"))
    return df.select(
        "id", F.col("title").alias("raw_title"), title.alias("t"), F.replace(title, F.lit(" "), F.lit("")).alias("tc"), text.empty(F.col("date_start")).alias("day"),
        text.normalize_location_dedup(F.col("location")).alias("place"), text.normalize_organizer(F.col("organizer")).alias("org"), text.squeeze(F.col("organizer")).alias("org_plain"),
        text.organizer_without_form(F.col("organizer")).alias("org_form"), F.length(text.empty(F.col("description"))).alias("len"),
    )


def _candidates(rows: DataFrame, block: Sequence[str], short_key: Column, long_keys: Column) -> DataFrame:
    """Pairs (a, b) of a block whose short side's key is among the long side's; ``a`` is the short side."""
    a = rows.select([F.col(c).alias(f"a_{c}") for c in rows.columns] + [short_key.alias("__g")])
    b = rows.select([F.col(c).alias(f"b_{c}") for c in rows.columns] + [F.explode(long_keys).alias("__g")])
    same = [a["__g"] == b["__g"]] + [a[f"a_{c}"] == b[f"b_{c}"] for c in block]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return a.join(b, on).filter(F.col("a_id") != F.col("b_id")).drop("__g")


def _ordered(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.lit(name).alias("pass")).distinct()


def _alike(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """Rows that no predicate of a pass tells apart, as one: the first of them stands for all."""
    return rows.groupBy(*block, "t", "tc", "org", "org_plain").agg(F.min("id").alias("id"))


def same_place_pairs(rows: DataFrame, guard: str = "contain") -> DataFrame:
    """Pass 1: same date and district; titles equal, or both over 6 letters and one contained in the other, with or without spaces.

    Rows with equal titles are linked to the first of their group, and groups are matched by their first rows: the
    same components as from all pairs, without a pair for each two copies.
    """
    ok = compatible(F.col("a_org"), F.col("b_org"), guard)
    block = ["day", "place"]
    long_ = _alike(rows, block).filter((F.length("t") > 6) & (F.length("tc") > 0))
    inside = _candidates(long_, block, _one_gram(F.col("tc")), _grams(F.col("tc")))
    # A short text whose length is under a gram is its own gram: only equal texts meet, longer ones are looked up piece by piece.
    contained = inside.unionByName(_candidates_tiny(long_, block)).filter(F.contains("b_tc", F.col("a_tc")) & (F.col("a_t") != F.col("b_t")) & ok)
    return _ordered(contained, "place").unionByName(equal_pairs(rows, [*block, "t"], "org", guard, "place")).distinct()


def _candidates_tiny(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """Candidates whose compact title is shorter than a gram, against the pieces of that length."""
    few = rows.filter(F.length("tc") < GRAM)
    pieces = F.flatten(F.array(*[_grams(F.col("tc"), k) for k in range(1, GRAM)]))
    a = few.select([F.col(c).alias(f"a_{c}") for c in rows.columns] + [F.col("tc").alias("__g")])
    b = rows.join(few.select(*block).distinct(), [*block], "left_semi").select([F.col(c).alias(f"b_{c}") for c in rows.columns] + [F.explode(F.array_distinct(pieces)).alias("__g")])
    on = a["__g"] == b["__g"]
    for c in block:
        on = on & (a[f"a_{c}"] == b[f"b_{c}"])
    return a.join(b, on).filter(F.col("a_id") != F.col("b_id")).drop("__g")


def equal_pairs(rows: DataFrame, block: Sequence[str], org: str, guard: str, name: str) -> DataFrame:
    """Rows alike in the block's columns whose organizers agree.

    Rows with the same organizer are linked to the first of them; different organizers are
    compared once, as groups, not row by row.
    """
    groups = rows.groupBy(*block, org).agg(F.min("id").alias("first"))
    within = rows.join(groups, [*block, org]).filter(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    out = within
    if guard != "equal":
        one, two = groups.withColumnsRenamed({"first": "a", org: "oa"}), groups.withColumnsRenamed({"first": "b", org: "ob"})
        across = one.join(two, [*block]).filter((F.col("oa") != F.col("ob")) & text.either_contains(F.col("oa"), F.col("ob")) & (F.col("a") < F.col("b"))).select("a", "b")
        out = within.unionByName(across)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(name).alias("pass")).distinct()


def _candidates_by_word(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """Candidates whose ``words`` may all be parts of the other's: the longest word is posted under one gram of its own.

    Only where it is shorter than a gram it is looked up whole, among the shorter pieces of the blocks that have such a title.
    """
    rows = rows.withColumn("longest", F.element_at(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"])
    tiny = F.length("longest") < GRAM
    some = _candidates(rows, block, F.when(~tiny, _one_gram(F.col("longest"))), F.array_distinct(F.flatten(F.transform("words", lambda w: _grams(w)))))
    near = rows.join(rows.filter(tiny).select(*block).distinct(), [*block], "left_semi")
    pieces = F.array_distinct(F.flatten(F.transform("words", lambda w: F.concat(*[_grams(w, k) for k in range(1, GRAM)]))))
    return some.unionByName(_candidates(near, block, F.when(tiny, F.col("longest")), pieces)).drop("a_longest", "b_longest")


def any_place_pairs(rows: DataFrame, guard: str = "contain") -> DataFrame:
    """Pass 2: same date, titles different, both over 6 letters without spaces; one holds the other and is at most twice as long, or every word of the short is part of a word of the long.

    Of two titles alike in length either may be the short one. Groups of rows alike in title and organizer are matched
    by their first rows; the other rows of a matched group are linked to its first partner.
    """
    groups = _alike(rows, ["day"])
    long_ = groups.filter(F.length("tc") > 6).withColumn("words", F.filter(F.split("t", r"(?U)\s+"), lambda w: w != ""))
    a_may_be_long = F.length("a_t") >= F.length("b_t")
    whole = _candidates(long_, ["day"], _one_gram(F.col("tc")), _grams(F.col("tc"))).filter(F.contains("b_tc", F.col("a_tc")) & (a_may_be_long | (F.length("a_tc") >= F.length("b_tc") * 0.5)))
    words_inside = F.forall("a_words", lambda w: F.exists("b_words", lambda x: F.contains(x, w)))
    by_word = _candidates_by_word(long_, ["day"]).filter((F.length("a_t") <= F.length("b_t")) & words_inside)
    ok = compatible(F.col("a_org"), F.col("b_org"), guard) if guard == "contain" else compatible(F.col("a_org_plain"), F.col("b_org_plain"), "contain")
    matched = whole.unionByName(by_word).filter((F.col("a_t") != F.col("b_t")) & ok).select("a_id", "b_id").distinct()
    either = matched.unionByName(matched.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")))
    partner = either.groupBy(F.col("a_id").alias("first")).agg(F.min("b_id").alias("b_id"))
    first = rows.join(groups.withColumnRenamed("id", "first"), ["day", "t", "tc", "org", "org_plain"]).select("id", "first").filter("id <> first")
    rest = first.join(partner, "first").select(F.col("id").alias("a_id"), "b_id")
    return _ordered(matched.unionByName(rest), "date")


def manual_pairs(rows: DataFrame, dupes: dict[str, list[str]] = D.MANUAL_DUPES) -> DataFrame:
    """Pass 3: a title and the variants listed for it, on the same date."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(c, v) for c, vs in dupes.items() for v in vs], "canon string, variant string")
    firsts = rows.groupBy("raw_title", "day").agg(F.min("id").alias("first"))
    canon = firsts.join(F.broadcast(names), firsts.raw_title == names.canon).select(F.col("day").alias("cday"), "variant", F.col("first").alias("a"))
    found = rows.join(canon, (rows.raw_title == canon.variant) & (rows.day == canon.cday)).select(F.col("a").alias("a_id"), F.col("id").alias("b_id"))
    return _ordered(found.filter("a_id <> b_id"), "manual")


def best_pairs(rows: DataFrame, block: Sequence[str], test, name: str) -> DataFrame:
    """Every row of a block against the row with the longest description, the first of them."""
    best = rows.groupBy(*block).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in block]), F.struct("len", -F.col("id"))).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = rows.join(best, [*block]).filter(F.col("id") != F.col("best.id")).filter(test)
    return _ordered(pairs.select(F.col("best.id").alias("a_id"), F.col("id").alias("b_id")), name)


def same_title_pairs(rows: DataFrame) -> DataFrame:
    """Pass 4: same title and date, organizers that agree with the best row's."""
    return best_pairs(rows, ["t", "day"], text.either_contains(F.col("best.org_plain"), F.col("org_plain")), "title")


def shared_word_pairs(rows: DataFrame, least: int = 2) -> DataFrame:
    """Pass 5: same date and organizer (the empty one too), at least two words in common with the best row's title."""
    worded = rows.withColumn("words", F.array_distinct(F.filter(F.split("t", r"(?U)\s+"), lambda w: w != "")))
    return best_pairs(worded, ["day", "org_form"], F.size(F.array_intersect("best.words", "words")) >= least, "words")


def organizer_pairs(df: DataFrame, merge: dict[str, str] = D.MANUAL_ORG_MERGE) -> DataFrame:
    """Pass 6: same date, both organizers holding the listed short name, or both the long one; linked through the first."""
    low = F.lower(text.strip(text.empty(F.col("organizer"))))
    out = None
    for a, b in merge.items():
        for name in (a.lower(), b.lower()):
            hit = df.filter(F.contains(low, F.lit(name))).select("id", text.empty(F.col("date_start")).alias("day"))
            firsts = hit.groupBy("day").agg(F.min("id").alias("a_id"))
            pairs = hit.join(firsts, "day").filter("id <> a_id").select("a_id", F.col("id").alias("b_id"))
            out = pairs if out is None else out.unionByName(pairs)
    return _ordered(out, "organizer")


def merge(df: DataFrame, pairs: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Join the rows that pairs connect: the row with the longest description survives, the first of them; sources and tags of all are united, in order.

    Also returns ``links`` with curated ids led to the survivors.
    """
    labels = components(pairs.select("a", "b")).withColumnRenamed("node", "id")
    placed = df.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    listed = [c for c in ("sources", "tags") if c in df.columns]
    aggs = [longest([c for c in df.columns if c not in listed], "id").alias("best")] + [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in listed]
    joined = placed.groupBy("label").agg(*aggs)
    out = joined.select("best.*", *listed).select(df.columns)
    if links is None:
        return out, None
    moved = placed.select(F.col("id").alias("curated_id"), "label").join(joined.select("label", F.col("best.id").alias("now")), "label").select("curated_id", "now")
    return out, links.join(moved, "curated_id", "left").withColumn("curated_id", F.coalesce("now", "curated_id")).select(links.columns)


def fuzzy_merge(df: DataFrame, version: int = 2, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """All passes in order, each on the survivors of the one before. Version 1 guards by containment and has four passes, version 2 guards pass 1 by equality and has six."""
    guard = "contain" if version == 1 else "equal"
    passes = [lambda d: same_place_pairs(keyed(d), guard), lambda d: any_place_pairs(keyed(d), guard), lambda d: manual_pairs(keyed(d)), lambda d: same_title_pairs(keyed(d))]
    if version == 2:
        passes += [lambda d: shared_word_pairs(keyed(d)), organizer_pairs]
    for step in passes:
        df, links = merge(df, step(df), links)
        df = materialize(df, "merged")
        links = materialize(links, "links") if links is not None else None
    return df, links


def greedy_merge(df: DataFrame, guard: str = "equal") -> DataFrame:
    """Pass 1 as a loop: the first matching pair of a block is merged until none is left.

    Differs from components only where a survivor no longer matches what the
    loser matched. A block (date and district) is one group here, so it is for blocks known to be small.
    """
    columns = df.columns
    rows = df.withColumn("__t", text.normalize_title(F.col("title"))).withColumn("__o", text.normalize_organizer(F.col("organizer"))).withColumn("__day", text.empty(F.col("date_start"))).withColumn("__place", text.normalize_location_dedup(F.col("location")))

    def alike(a, b) -> bool:
        x, y = a["__t"], b["__t"]
        p, q = re.sub(" ", "", x), re.sub(" ", "", y)
        if x != y and not (min(len(x), len(y)) > 6 and (p in q or q in p)):
            return False
        o, r = a["__o"], b["__o"]
        return o == r or guard == "contain" and (o in r or r in o)

    def block(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["title", "id"]).to_dict("records")
        again = True
        while again:
            again = False
            for i, a in enumerate(rows):
                j = next((j for j in range(i + 1, len(rows)) if alike(a, rows[j])), None)
                if j is not None:
                    b = rows[j]
                    keep, drop = (b, j) if len(b["description"] or "") > len(a["description"] or "") else (a, i)
                    other = a if keep is b else b
                    keep["sources"] = sorted({*keep["sources"], *other["sources"]})
                    rows.pop(i if keep is b else j)
                    again = True
                    break
        return pd.DataFrame(rows, columns=group.columns)[columns]

    return rows.groupBy("__day", "__place").applyInPandas(block, df.schema)


def raw_duplicates(raw: DataFrame, links: DataFrame, curated: DataFrame) -> DataFrame:
    """``ord, reason`` of raw rows to delete: ``duplicate`` (a longer, or earlier, description stands for the same curated row, title, date and source) or ``orphan``."""
    keys = ["curated_id", "t", "day", "source_url"]
    linked = raw.join(links.select(F.col("raw_id").alias("ord"), "curated_id").join(curated.select(F.col("id").alias("curated_id")), "curated_id"), "ord")
    rows = linked.select("ord", "curated_id", text.normalize_title(F.col("title")).alias("t"), text.empty(F.col("date_start")).alias("day"), "source_url", F.length(text.empty(F.col("description"))).alias("len"))
    best = rows.groupBy(*keys).agg(F.max_by("ord", F.struct("len", -F.col("ord"))).alias("best"))
    same = [rows[k].eqNullSafe(best[k]) for k in keys]
    on = same[0] & same[1] & same[2] & same[3]
    again = rows.join(best, on).filter(F.col("ord") != F.col("best")).select("ord", F.lit("duplicate").alias("reason"))
    orphans = raw.select("ord").join(links.select(F.col("raw_id").alias("ord")), "ord", "left_anti").withColumn("reason", F.lit("orphan"))
    return again.unionByName(orphans)


def fill_from_siblings(df: DataFrame, least: int = 20, id_col: str = "id") -> DataFrame:
    """Descriptions shorter than ``least`` replaced by the longest sibling's: of the normalized title, else of the title. The longest two of a group are enough to leave out the row itself."""
    d = text.strip(text.empty(F.col("description")))

    def best(key: str) -> DataFrame:
        rows = df.filter(text.empty(F.col(key)) != "").select(F.col(key).alias(f"__{key}"), F.struct((-F.length(d)).alias("n"), F.col(id_col).alias("id"), d.alias("d")).alias("s")).filter(F.length(F.col("s.d")) >= least)
        first = rows.groupBy(f"__{key}").agg(F.min("s").alias("s1"))
        second = rows.join(first, f"__{key}").filter(F.col("s.id") != F.col("s1.id")).groupBy(f"__{key}").agg(F.min("s").alias("s2"))
        return first.join(second, f"__{key}", "left").withColumnsRenamed({"s1": f"{key}_1", "s2": f"{key}_2"})

    out = df.join(best("normalized_title"), F.col("normalized_title") == F.col("__normalized_title"), "left").join(best("title"), F.col("title") == F.col("__title"), "left")
    pick = lambda k: F.when(F.col(f"{k}_1.id") != F.col(id_col), F.col(f"{k}_1.d")).otherwise(F.col(f"{k}_2.d"))
    filled = F.when(F.length(d) < least, F.coalesce(pick("normalized_title"), pick("title"), F.col("description"))).otherwise(F.col("description"))
    return out.withColumn("description", filled).select(df.columns)


def look_up_descriptions(df: DataFrame, raw: DataFrame, id_col: str = "id") -> DataFrame:
    """Descriptions of one to four characters replaced by the longest raw one of the date whose title holds this one's, in any case of letters; '' without one.

    Titles of a date are compared once each, as groups, and meet by a piece of the poor row's title as in the fuzzy passes;
    ties of length go to the greater text. A row without title or date finds nothing, an empty title is in every title.
    """
    d = text.strip(text.empty(F.col("description")))
    best = F.max_by("d", F.struct(F.length("d"), F.col("d"))).alias("d")
    poor = df.filter(F.length(d).between(1, 4)).select(F.lower("title").alias("t"), F.col("date_start").alias("day")).distinct()
    rich = raw.filter(F.length("description") > 5).select(F.lower("title").alias("rt"), F.col("date_start").alias("day"), F.col("description").alias("d")).filter("rt is not null").groupBy("day", "rt").agg(best)
    n = F.length("t")
    tiny = poor.filter(n.between(1, GRAM - 1))

    def met(few: DataFrame, key: Column, rows: DataFrame, keys: Column) -> DataFrame:
        return few.withColumn("g", key).join(rows.withColumn("g", F.explode(keys)), ["day", "g"]).filter(F.contains("rt", F.col("t"))).select("day", "t", "d")

    pieces = F.array_distinct(F.concat(*[_grams(F.col("rt"), k) for k in range(1, GRAM)]))
    found = (
        met(poor.filter(n >= GRAM), _one_gram(F.col("t")), rich, _grams(F.col("rt")))
        .unionByName(met(tiny, F.col("t"), rich.join(tiny.select("day").distinct(), "day", "left_semi"), pieces))
        .unionByName(poor.filter(n == 0).join(rich.groupBy("day").agg(best), "day").select("day", "t", "d"))
        .groupBy(F.col("day").alias("__day"), F.col("t").alias("__t")).agg(best.alias("__d"))
    )
    out = df.join(found, (F.col("date_start") == F.col("__day")) & (F.lower("title") == F.col("__t")), "left")
    return out.withColumn("description", F.when(F.length(d).between(1, 4), F.coalesce("__d", F.lit(""))).otherwise(F.col("description"))).select(df.columns)


def neighbours(df: DataFrame, key: Sequence[str], id_col: str, label: str) -> DataFrame:
    """``id, n_others, others``: the other rows of a row's key.

    What a row gets grows with its key's rows, so this is for keys with few rows each, as the
    events of one day and district; ``quality.context`` counts them for keys of any size. The labels of a key are gathered
    once for each key and joined back; the row itself is taken out there.
    """
    all_ = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(label).alias("label")))).alias("all"))
    out = df.select(id_col, *key).join(all_, [*key])
    others = F.transform(F.filter("all", lambda s: s["id"] != F.col(id_col)), lambda s: s["label"])
    return out.select(id_col, *key, F.size(others).alias("n_others"), others.alias("others"))


def lookup_names(df: DataFrame, ids: str, names: DataFrame, id_col: str, into: str, glue: str = ", ") -> DataFrame:
    """Ids of an array column replaced by their names, joined in order; unknown ids are left out."""
    row = df.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in df.columns else df
    row = materialize(row, "rows")
    each = row.select("__row", F.posexplode(ids).alias("__at", "__id"))
    named = each.join(names.select(F.col("id").alias("__id"), F.col("name").alias("__name")), "__id").groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__name"))), lambda s: s["__name"]), glue).alias(into))
    return row.join(named, "__row", "left").withColumn(into, text.empty(F.col(into))).drop("__row")


def redirects(new: DataFrame, pairs: DataFrame) -> DataFrame:
    """``old_id, new_id`` for the redirects whose target exists; the largest old id where several lead there."""
    last = pairs.groupBy("new_id").agg(F.max("old_id").alias("old_id"))
    return last.join(new.select(F.col("id").alias("new_id")), "new_id", "left_semi").select("old_id", "new_id")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, action``: A (added), D (deleted) or M (changed) between two snapshots."""
    a = before.select(F.col(key).alias("k"), F.struct(*columns).alias("va"), F.lit(True).alias("in_a"))
    b = after.select(F.col(key).alias("k"), F.struct(*columns).alias("vb"), F.lit(True).alias("in_b"))
    action = F.when(F.col("in_a").isNull(), "A").when(F.col("in_b").isNull(), "D").when(~F.col("va").eqNullSafe(F.col("vb")), "M")
    return a.join(b, "k", "full").select(F.col("k").alias(key), action.alias("action")).filter("action is not null")


def overlay(base: DataFrame, detail: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """List rows with the fields that their detail page gives; empty details change nothing."""
    renamed = detail.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(renamed, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(text.empty(F.col(f"__{c}")) != "", F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(base.columns)
