"""Counts as partial aggregates: one pass, combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import text

#: The shortest description that is not short.
SHORT = 20


def by_group(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column] | None = None, listed: Sequence[str] = ()) -> DataFrame:
    """Rows of each group as ``n``, those that meet each condition under its name, and the distinct values of ``listed`` columns in order, joined by commas.

    Without keys one row for the whole table, also if it is empty. A condition that is null is not met; null values are not listed.
    """
    counted = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in (conditions or {}).items()]
    names = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in listed]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counted, *names)


def most_frequent_first(counted: DataFrame, key: str) -> DataFrame:
    """Groups by falling count, ties by key."""
    return counted.orderBy(F.col("n").desc(), F.col(key))


def cleanup_counts(df: DataFrame, description: str = "description", filled: str | None = None) -> DataFrame:
    """One row of counters of what cleaning ``description`` does: each step counts the rows it changes after the steps before it.

    ``filled``: a boolean column that marks rows whose text came from a sibling. Null descriptions are empty ones.
    """
    before = text.empty(F.col(description))
    steps = text.description_steps(before)
    names = [*steps]
    done = df.select(before.alias("before"), *[c.alias(k) for k, c in steps.items()], (F.col(filled) if filled else F.lit(False)).alias("filled"))
    moved = {k: F.col(k) != F.col(names[i - 1] if i else "before") for i, k in enumerate(names)}
    changed = F.col("filled") | (F.col(names[-1]) != F.col("before"))
    conditions = {
        "html_entities_decoded": moved["decoded"], "html_tags_stripped": moved["untagged"], "whitespace_normalized": F.col("spaced") != F.col("mended"),
        "empty_before": F.length(text.strip(F.col("before"))) == 0, "short_before": F.length(text.strip(F.col("before"))).between(1, SHORT - 1), "filled_from_sibling": F.col("filled"),
        "scrap_garbage_removed": moved["cleaned"], "changed": changed, "unchanged": ~changed,
    }
    return by_group(done, [], conditions).withColumnRenamed("n", "total").withColumn("errors", F.lit(0).cast("long"))
