"""The curation pipelines, from raw records to published events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac import dictionaries as D
from almanac.operators import dedup, landing, series, tagging
from almanac.storage import materialize


def curate_v1(raw: DataFrame, today: str, previous: DataFrame | None = None, rules: D.TagRules | None = None) -> tuple[DataFrame, DataFrame]:
    """The table pipeline: raw hygiene, exact dedup, lineage, restoring, fuzzy passes 1-4, tags, strict recurrence, flags. Returns curated rows and lineage."""
    rules = rules or D.TagRules()
    clean = landing.dedup_filter(landing.dated(landing.well_formed(raw)))
    curated = materialize(dedup.exact_dedup(clean, kind="cased").withColumn("tags", F.array().cast("array<string>")), "exact")
    links = materialize(dedup.lineage(clean, curated), "lineage")
    if previous is not None:
        curated = dedup.restore_attributes(curated, previous)
    if "tags" in raw.columns:
        curated = dedup.carry_tags(curated, raw, links)
    curated, links = dedup.fuzzy_merge(curated, version=1, links=links)
    curated = tagging.tag_untagged(curated, rules)
    curated = series.mark_recurring(curated.drop("recurring_group_id"), "strict")
    return landing.mark_featured(landing.mark_passed(curated, today)), links


def curate_v2(raw: DataFrame, today: str, previous: DataFrame | None = None, rules: D.TagRules | None = None) -> DataFrame:
    """The in-memory pipeline: rows of silent sources come back, then filter, exact dedup, fuzzy passes 1-6, flags, merged tags, majority recurrence."""
    rules = rules or D.TagRules()
    if previous is not None:
        # Rows that come back stand after all new ones, under numbers of their own.
        back = landing.silent_sources(previous, raw).withColumn("ord", F.col("ord") + F.lit(1 << 40))
        raw = raw.unionByName(back, allowMissingColumns=True)
    rows = landing.document_filter(raw)
    curated = materialize(dedup.exact_dedup(rows), "exact")
    if "tags" not in curated.columns:
        curated = curated.withColumn("tags", F.array().cast("array<string>"))
    curated, _ = dedup.fuzzy_merge(curated, version=2)
    curated = tagging.tag_merge(landing.mark_passed(curated, today), rules)
    return series.mark_recurring(curated, "majority")
