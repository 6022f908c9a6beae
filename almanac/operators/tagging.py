"""Tags from ordered dictionaries, in one projection without user functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac import dictionaries as D
from almanac.functions import text


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _present(tests: Sequence[Column]) -> Column:
    """The non-null ones, in order."""
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def first_match(c: Column, names: dict[str, str]) -> Column:
    """Value of the first key that occurs in a text; null without one."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in names.items()]) if names else F.lit(None).cast("string")


def match_districts(c: Column, districts: dict[str, list[str]] = D.DISTRICTS, exclusions: dict[str, list[str]] = D.DISTRICT_EXCLUSIONS) -> Column:
    """Districts with a keyword in a lower-case text, in order, unless one of their exclusions occurs."""
    return _present([F.when(text.contains_any(c, words) & ~text.contains_any(c, exclusions.get(d, [])), F.lit(d)) for d, words in districts.items()])


def first_pattern(c: Column, patterns: dict[str, Sequence[str]]) -> Column:
    """The first name with a pattern that matches."""
    return F.coalesce(*[F.when(c.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(n)) for n, ps in patterns.items()])


def find_district(tags: Column, known: Sequence[str] = D.AVAILABLE_DISTRICTS) -> Column:
    """The first tag that is a district, else 'unknown'."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t.isin([*known])), F.lit(0)), F.lit("unknown"))


def auto_tag(title: Column, description: Column, location: Column, organizer: Column, rules: D.TagRules) -> Column:
    """Tags of an event.

    A title on the exclusive list gives its tag alone. Else keywords in title and
    description give tags in dictionary order, false positives go, and only then the
    first few stay. Titles with fixed tags and exclusive organizers add theirs after that,
    and the districts of location and organizer follow. A null title or description
    reads as 'None'.
    """
    t, o = F.lower(text.empty(title)), F.lower(text.empty(organizer))
    words = F.lower(F.concat(F.coalesce(title, F.lit("None")), F.lit(" "), F.coalesce(description, F.lit("None"))))
    exclusive = first_match(t, rules.title_exclusive)
    of_keywords = _present([F.when(text.contains_any(words, keys) & ~text.contains_any(words, rules.false_positives.get(tag, [])), F.lit(tag)) for tag, keys in rules.keywords.items()])
    content = F.when(exclusive.isNotNull(), F.array(exclusive)).otherwise(F.slice(of_keywords, 1, rules.most_content_tags))
    always = F.flatten(F.array(*[F.when(F.contains(t, F.lit(k)), _strings(v)).otherwise(_strings([])) for k, v in rules.title_always.items()])) if rules.title_always else _strings([])
    content = F.concat(content, F.array_except(always, content))
    by_organizer = F.when(exclusive.isNull(), first_match(o, rules.organizer_exclusive))
    content = F.when(by_organizer.isNotNull() & ~F.array_contains(content, F.coalesce(by_organizer, F.lit(""))), F.concat(content, F.array(by_organizer))).otherwise(content)
    here = match_districts(F.lower(text.empty(location)), rules.districts, rules.district_exclusions)
    there = match_districts(o, rules.districts, rules.district_exclusions)
    return F.concat(content, here, F.array_except(there, here))


def tagged(df: DataFrame, rules: D.TagRules, into: str = "auto_tags") -> DataFrame:
    return df.withColumn(into, auto_tag(F.col("title"), F.col("description"), F.col("location"), F.col("organizer"), rules))


def tag_untagged(df: DataFrame, rules: D.TagRules, force: bool = False) -> DataFrame:
    """Fill ``tags`` where there are none, or everywhere if forced; no tags never replace any."""
    out = tagged(df, rules, "__tags")
    open_ = F.col("tags").isNull() | (F.size("tags") == 0) | F.lit(force)
    return out.withColumn("tags", F.when(open_ & (F.size("__tags") > 0), F.col("__tags")).otherwise(F.col("tags"))).drop("__tags")


def tag_merge(df: DataFrame, rules: D.TagRules) -> DataFrame:
    """Existing tags first, then automatic ones that are not among them."""
    out = tagged(df, rules, "__tags")
    old = F.coalesce(F.col("tags"), _strings([]))
    return out.withColumn("tags", F.when(F.size(old) > 0, F.concat(old, F.array_except("__tags", old))).otherwise(F.col("__tags"))).drop("__tags")
