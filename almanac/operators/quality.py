"""Quality scores of events and the loop of repair and judgement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac import dictionaries as D
from almanac.functions import text
from almanac.operators.rules import apply_rules
from almanac.operators.tagging import find_district
from almanac.storage import materialize

MIN_SCORE = 0.6
Scorer = Callable[[DataFrame], DataFrame]


def context(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, n_same``: other events of the same date and district; 'unknown' is a district."""
    placed = df.withColumn("__d", find_district(F.col("tags")))
    n = placed.groupBy("__d", "date_start").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(n, ["__d", "date_start"]).select(id_col, (F.col("n") - 1).alias("n_same"))


def _score(test: Column, good: float = 1.0, bad: float = 0.3) -> Column:
    return F.when(test, F.lit(good)).otherwise(F.lit(bad))


def heuristic_scores() -> dict[str, Column]:
    """A score from 0 to 1 for each axis, from the row alone: a stand-in where no external judge is at hand."""
    title, d = text.empty(F.col("title")), F.length(text.empty(F.col("description")))
    return dict(zip(D.QUALITY_AXES, [
        _score(~F.lower(text.strip(title)).isin(D.GENERIC_TITLES) & (F.length(title) >= 5)),
        _score(text.empty(F.col("location")) != ""),
        _score(text.empty(F.col("time_raw")).rlike(r"\d")),
        F.when(d >= 80, 1.0).when(d >= 20, 0.7).when(d > 0, 0.4).otherwise(0.2),
        _score((F.size("tags") > 0) & (find_district(F.col("tags")) != "unknown"), 1.0, 0.4),
        _score(F.size("sources") <= 3, 1.0, 0.6),
    ]))


def heuristic_scorer(df: DataFrame) -> DataFrame:
    """Adds ``_quality``: judgments of each axis, overall score (their mean), passed, summary."""
    scores = heuristic_scores()
    overall = F.round(sum(scores.values()) / len(scores), 4)
    issues = {a: F.when(s < MIN_SCORE, F.array(F.lit(a.replace("_", " ") + " is weak"))).otherwise(F.array().cast("array<string>")) for a, s in scores.items()}
    judgments = F.create_map(*[x for a, s in scores.items() for x in (F.lit(a), F.struct(s.cast("double").alias("score"), issues[a].alias("issues")))])
    return df.withColumn("_quality", F.struct(judgments.alias("judgments"), overall.alias("overall_score"), (overall >= MIN_SCORE).alias("passed"), F.lit("heuristic").alias("summary")))


def judgement_from_reply(reply: Column) -> Column:
    """``_quality`` from a model's reply: code fences off, JSON parsed; 0.5 on every axis, 0 overall and not passed where it can't be read."""
    body = text.strip(F.regexp_replace(F.regexp_replace(reply, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)```.*$", ""))
    kind = "judgments map<string,struct<score:double,issues:array<string>>>, overall_score string, summary string"
    read = F.from_json(body, kind)
    overall = text.as_float(read["overall_score"])
    failed = F.create_map(*[x for a in D.QUALITY_AXES for x in (F.lit(a), F.struct(F.lit(0.5).alias("score"), F.array(F.lit("no judgement")).alias("issues")))])
    return F.struct(F.coalesce(read["judgments"], failed).alias("judgments"), overall.alias("overall_score"), (overall >= MIN_SCORE).alias("passed"), text.empty(read["summary"]).alias("summary"))


def to_judge_again(df: DataFrame, most: int | None = None, order: str = "id") -> DataFrame:
    """Rows that did not pass, the first ``most`` of them if given."""
    out = df.filter(~F.coalesce(F.col("_quality.passed"), F.lit(False)))
    return out if most is None else out.orderBy(order).limit(most)


def quality_loop(df: DataFrame, scorer: Scorer = heuristic_scorer, most: int = 5, rules: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """Judge, repair what changed, judge again, until no rule changes a row or ``most`` rounds are over. Returns the rows and the rounds."""
    now = materialize(scorer(df), "judged")
    for turn in range(1, most + 1):
        fixed = materialize(apply_rules(now.drop("_quality"), rules), "repaired")
        if not fixed.filter(F.size("applied_rules") > 0).limit(1).count():
            return now, turn
        now = materialize(scorer(fixed.drop("applied_rules")), "judged")
    return now, most


def summary(df: DataFrame) -> DataFrame:
    """``passed, n`` of judged rows."""
    return df.groupBy(F.col("_quality.passed").alias("passed")).agg(F.count(F.lit(1)).alias("n"))


def failed_axes(df: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``axis, n``: how often each axis fell short."""
    each = df.select(F.explode("_quality.judgments").alias("axis", "j"))
    return each.filter(F.col("j.score") < least).groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
