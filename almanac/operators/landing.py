"""Landing and filtering: what enters the raw table, what stays there, what is published."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac import dictionaries as D
from almanac.functions import dates, text
from almanac.operators.numbering import numbered
from almanac.storage import materialize

RAW_SCHEMA = "title string, date_start string, date_end string, time_raw string, location string, organizer string, description string, event_url string"
RAW_KEY = ("source_url", "event_url", "date_start", "title")
PUBLISHED = ("title", "date_start", "date_end", "time_raw", "location", "organizer", "description", "event_url", "sources", "tags", "recurring_group_id", "is_passed", "featured")

#: Sizes of the pieces that titles meet by where one may hold another.
PIECES = (1, 2, 4, 8, 16, 32)


def blocked(title: Column, titles: Sequence[str] = D.BLOCKED_TITLES, prefixes: Sequence[str] = D.BLOCKED_PREFIXES, any_case: bool = False) -> Column:
    """Whether a title is on the block list or starts with a blocked prefix; ``any_case`` as LIKE compares."""
    t = text.empty(title)
    starts = [F.lower(t).startswith(p.lower()) if any_case else t.startswith(p) for p in prefixes]
    return reduce(lambda a, b: a | b, starts, t.isin([*titles]))


def landing_filter(df: DataFrame, today: Column, titles: Sequence[str] = D.BLOCKED_TITLES, prefixes: Sequence[str] = D.BLOCKED_PREFIXES) -> DataFrame:
    """Rows that may land: not blocked, not past."""
    return df.filter(~blocked(F.col("title"), titles, prefixes) & ~dates.is_past(F.col("date_start"), today))


def dedup_filter(df: DataFrame, titles: Sequence[str] = D.BLOCKED_TITLES, prefixes: Sequence[str] = D.BLOCKED_PREFIXES) -> DataFrame:
    """Rows of the raw table that are deduplicated: title and date present, not blocked in any case of letters."""
    return df.filter((text.empty(F.col("title")) != "") & (text.empty(F.col("date_start")) != "") & ~blocked(F.col("title"), titles, prefixes, any_case=True))


def document_filter(df: DataFrame, titles: Sequence[str] = D.BLOCKED_TITLES, prefixes: Sequence[str] = D.BLOCKED_PREFIXES) -> DataFrame:
    """The looser filter of the in-memory pipeline: an empty date is allowed, any other must begin like an ISO date; quoted titles lose their quotes."""
    date = text.empty(F.col("date_start"))
    kept = df.filter(~blocked(F.col("title"), titles, prefixes) & (text.strip(text.empty(F.col("title"))) != "") & ((date == "") | date.rlike(r"^\d{4}-\d{2}-\d{2}")))
    return kept.withColumn("title", unquoted_title(F.col("title"), F.col("date_start")))


def unquoted_title(title: Column, date: Column) -> Column:
    bare = F.when((F.length(title) > 2) & title.startswith('"') & title.endswith('"'), text.strip(F.substring(title, F.lit(2), F.length(title) - 2))).otherwise(title)
    return F.when(text.strip(bare) == "", F.concat(F.lit("Untitled ("), F.coalesce(date, F.lit("None")), F.lit(")"))).otherwise(bare)


def dated(df: DataFrame) -> DataFrame:
    """Without rows that have no date."""
    return df.filter(text.empty(F.col("date_start")) != "")


def well_formed(df: DataFrame) -> DataFrame:
    """Without dates of another shape than ``____-__-__``; only the shape is looked at."""
    d = text.empty(F.col("date_start"))
    return df.filter((d == "") | d.like("____-__-__"))


def only_sources(df: DataFrame, wanted: Sequence[str], column: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted sources, and the wanted names that have no rows."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} string")
    return df.filter(F.col(column).isin([*wanted])), names.join(df.select(column).distinct(), column, "left_anti")


def without_contained(df: DataFrame, key: str, start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Rows that the interval kept last for their key doesn't contain, in order.

    Which interval was kept last depends on every row before, so each key's rows are
    walked through, streamed from a sort: a key may have any number of rows.
    """
    import pyarrow as pa

    cols, schema = df.columns, df.schema
    at = {c: i for i, c in enumerate(cols)}

    def walk(batches):
        last = None
        for batch in batches:
            keep = []
            k, s, e = (batch.column(at[c]).to_pylist() for c in (key, start, end))
            for name, a, b in zip(k, s, e):
                b1 = b or a
                if last is not None and last[0] == name:
                    inside = last[1] <= a <= last[2] and last[1] <= b1 <= last[2]
                    if inside or (a == b and last[1] == last[2]):
                        keep.append(False)
                        continue
                last = (name, a, b1)
                keep.append(True)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(walk, schema)


def mark_passed(df: DataFrame, today: str) -> DataFrame:
    """``is_passed`` 0 or 1: whether the end, or the start where there is none, lies before ``today``; recomputed, so it can go back to 0."""
    last = F.coalesce(F.when(F.col("date_end") == "", F.lit(None)).otherwise(F.col("date_end")), F.col("date_start"))
    return df.withColumn("is_passed", F.coalesce((last < today).cast("int"), F.lit(0)))


def mark_featured(df: DataFrame, ids: Sequence[int] = D.FEATURED_IDS, id_col: str = "id") -> DataFrame:
    """``featured`` 1 for rows that were featured or whose id is listed."""
    was = F.coalesce(F.col("featured"), F.lit(0)) == 1 if "featured" in df.columns else F.lit(False)
    return df.withColumn("featured", (was | F.col(id_col).isin([*ids])).cast("int"))


def choose_featured(df: DataFrame, ids: Sequence[int], districts: Sequence[str], force: bool = False) -> DataFrame:
    """Feature exactly four events: all exist, none passed or blocked, each of the districts by tag or by location, unless forced; else ValueError and nothing changes."""
    if len(set(ids)) != 4:
        raise ValueError("exactly four different ids are needed")
    low = [d.lower() for d in districts]
    tags = F.transform(text.as_list(F.col("tags")), F.lower)
    here = F.arrays_overlap(tags, F.array(*[F.lit(d) for d in low])) | text.contains_any(F.lower(text.empty(F.col("location"))), low)
    fit = (F.coalesce(F.col("is_passed"), F.lit(0)) == 0) & (F.col("tags") != "blocked") & (here | F.lit(force))
    if df.filter(F.col("id").isin([*ids]) & fit).select("id").distinct().count() != 4:
        raise ValueError("an id is missing, passed, blocked, or of another district")
    return df.withColumn("featured", F.col("id").isin([*ids]).cast("int"))


def silent_sources(previous: DataFrame, current: DataFrame, column: str = "source_url") -> DataFrame:
    """Rows of the previous run whose source gave nothing this time."""
    return previous.join(current.select(column).distinct(), column, "left_anti").select(previous.columns)


def published(df: DataFrame) -> DataFrame:
    """The thirteen published fields with their defaults."""
    kinds = {"sources": "array<string>", "tags": "array<string>", "recurring_group_id": "long", "is_passed": "int", "featured": "int"}
    out = []
    for c in PUBLISHED:
        kind = kinds.get(c, "string")
        value = F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
        if kind == "array<string>":
            value = F.coalesce(value, F.array().cast(kind))
        elif kind == "int":
            value = F.coalesce(value, F.lit(0))
        elif c not in ("date_end", "recurring_group_id"):
            value = text.empty(value)
        out.append(value.alias(c))
    return df.select(*out)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_null: str | None = None) -> DataFrame:
    """The first row of each key in order; rows whose ``keep_null`` column is empty all stay.

    The winner is found by a partial aggregate, so a key may have any number of rows.
    """
    own = df if keep_null is None else df.filter(text.empty(F.col(keep_null)) != "")
    others = [c for c in df.columns if c not in keys]
    first = own.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*others).alias("_row"))).alias("_w"))
    out = first.select(*keys, *[F.col(f"_w._row.{c}").alias(c) for c in others]).select(df.columns)
    return out if keep_null is None else out.unionByName(df.filter(text.empty(F.col(keep_null)) == ""))


def upsert_ignore(existing: DataFrame, new: DataFrame, key: Sequence[str] = RAW_KEY, order: Sequence[str] = ()) -> DataFrame:
    """The new rows whose key the table lacks, one of each; a key with a null conflicts with nothing."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    order = [*order] or [c for c in new.columns if c not in key]
    fresh = distinct_first(new.filter(whole), key, order).join(existing.select(*key), [*key], "left_anti").select(new.columns)
    return fresh.unionByName(new.filter(~whole))


def add_missing_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Columns of ``schema`` that ``df`` lacks, with their defaults."""
    for f in schema:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit((defaults or {}).get(f.name)).cast(f.dataType))
    return df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _pieces(c: Column, size: Column) -> Column:
    """Hashes of the pieces of ``size`` letters of a text that has so many; '' is its one piece of size 0."""
    at = F.when(size == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length(c) - size + 1))
    return F.transform(at, lambda i: F.xxhash64(F.substring(c, i, size)))


def _some_pair(few: DataFrame, many: DataFrame, kept: str) -> DataFrame:
    """Rows of the ``kept`` side, ``few`` or ``many``, of which some title of ``few`` is part of a longer one of ``many``, on one date.

    A title of ``few`` is posted under one piece, of the largest size of ``PIECES`` that it has; one of ``many`` under all pieces
    of the sizes that its date needs. The titles are compared in a semi-join, so no pair becomes a row.
    """
    n = F.length("t")
    size = F.greatest(*[F.when(n >= k, F.lit(k)).otherwise(F.lit(0)) for k in PIECES])
    longest = many.groupBy("date").agg(F.max(n).alias("longest"))
    short = few.join(F.broadcast(longest), "date").filter(n < F.col("longest")).withColumn("size", size).select("date", "t", "size")
    sizes = short.groupBy("date").agg(F.collect_set("size").alias("sizes"))
    # The piece of smallest hash: common pieces are chosen no more than others.
    short = short.select("date", F.array_min(_pieces(F.col("t"), F.col("size"))).alias("piece"), "t")
    pieces = F.flatten(F.transform(F.filter("sizes", lambda k: k <= n), lambda k: _pieces(F.col("t"), k)))
    long_ = many.join(F.broadcast(sizes), "date").select("date", F.explode(F.array_distinct(pieces)).alias("piece"), "t")
    left, right = (short, long_) if kept == "few" else (long_, short)
    right = right.withColumnsRenamed({"date": "__date", "piece": "__piece", "t": "__t"})
    inside = F.contains("__t", F.col("t")) if kept == "few" else F.contains(F.col("t"), F.col("__t"))
    return left.join(right, (F.col("date") == F.col("__date")) & (F.col("piece") == F.col("__piece")) & inside, "left_semi").select("date", "t")


def fill_defaults(events: DataFrame, defaults: DataFrame, date: str = "date_start", title: str = "title") -> DataFrame:
    """The default rows that no event of their date resembles, as ``text.title_similar`` says, added to the events.

    Titles of a date are compared once each, by their forms: equal ones meet by a join, contained ones by a piece
    of the shorter, so either table may be long.
    """
    def titles(df: DataFrame, name: str) -> DataFrame:
        plain, bare = text.title_forms(F.col(title))
        return materialize(df.filter(F.col(date).isNotNull()).select(F.col(date).alias("date"), plain.alias("t"), bare.alias("s")).distinct(), name)

    there, wanted = titles(events, "events"), titles(defaults, "defaults")
    covered = (
        wanted.join(there, ["date", "s"], "left_semi").select("date", "t")
        .unionByName(_some_pair(wanted, there, "few"))
        .unionByName(_some_pair(there, wanted, "many"))
        .distinct().select(F.col("date").alias("__date"), F.col("t").alias("__t"))
    )
    kept = defaults.join(covered, (F.col(date) == F.col("__date")) & (text.title_forms(F.col(title))[0] == F.col("__t")), "left_anti")
    return events.unionByName(kept, allowMissingColumns=True)


def numbered_batches(df: DataFrame, order: Sequence[str], size: int = 500) -> DataFrame:
    """``batch``: rows in order, ``size`` to a batch."""
    return numbered(df, order, "__at").withColumn("batch", F.floor(F.col("__at") / size).cast("long")).drop("__at")
