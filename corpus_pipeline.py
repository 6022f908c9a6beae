"""The corpus pipeline: STAGES are applied in order, each to what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm import minhash, packing, quality_model, toxicity
from almanac.llm.common import materialize, table
from almanac.llm.registry import PACK_BUCKETS, PACK_TOKENS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    feats = materialize(quality_model.features(docs), "statistics")
    return quality_model.keep_good(docs, quality_model.fit(feats, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates on five-word shingles. Rows without id stay, and so does an id that comes with several texts while one of them is kept."""
    found = minhash.near_duplicates(docs, words=5, similarity=(80, 100))
    dropped = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in length buckets and batches."""
    return packing.pack(docs, PACK_BUCKETS, PACK_TOKENS)


STAGES = [("toxicity", toxicity_stage), ("quality classifier", quality_stage), ("near duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL cannot fit the classifiers; the stages are tested against held-out labels and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
