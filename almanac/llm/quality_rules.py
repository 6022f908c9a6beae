"""Quality rules: counts that any document must pass, then language-specific perplexity bands.

Grams of characters are counted over all documents by Spark, a modified Kneser-Ney model is made for
each language in tables (``charmodel``), every document is scored with its language's model, and
documents whose log perplexity lies outside the band of their language are rejected. Log perplexity is
taken for each word with a letter or digit, so that signs are charged to the words they stand beside: for each
character they would make a text more predictable.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanac.llm import charmodel
from almanac.llm.common import materialize, slices, utf8

#: Rows of all models up to which workers get them whole, some 60 MB; beyond, documents are joined with their grams in parts.
MODEL_ROWS = 1_000_000
#: The language of documents that name none.
OTHER = "other"
#: The part of its words that a document of one language is expected to hold in others.
FOREIGN = 0.2
#: Width of the bands beyond the quartiles, in interquartile ranges.
BELOW, ABOVE = 3.5, 3.5
#: Interquartile range of the normal distribution.
NORMAL = 1.349
#: Limits of the counting rules.
LEAST_WORDS, MOST_REPEATED = 10, (20, 100)
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words inside 5-word windows that occur twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(5):
        rolled = (rolled + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    seen = Counter(tuple(words[i : i + 5]) for i in at)
    hit = np.zeros(n + 5, np.int64)
    for i in at:
        if seen[tuple(words[i : i + 5])] > 1:
            hit[i] += 1
            hit[i + 5] -= 1
    return int((np.cumsum(hit) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    worded = [x for x in lines if x.strip(_WHITE)]
    return len(worded) - len(set(worded))


def _named(docs: DataFrame, langs: list[str] | None, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """``doc_id, lang, text``; a null language is OTHER, and so are those not in ``langs`` where it is given."""
    lang = F.col(lang_col).cast("string")
    named = F.coalesce(lang, F.lit(OTHER)) if langs is None else F.when(lang.isin(langs), lang).otherwise(F.lit(OTHER))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), named.alias("lang"), F.col(text_col).cast("string").alias("text"))


_SCORES = {"doc_id": pa.int64(), "lang": pa.string(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "n_lettered": pa.int64(), "log_perplexity": pa.float64(), "copy": pa.int64()}
_SCHEMA = ", ".join(f"{k} {({pa.int64(): 'long', pa.string(): 'string', pa.float64(): 'double'})[v]}" for k, v in _SCORES.items())


def _measured(batch: pa.RecordBatch, scorers: charmodel.Scorers) -> pa.RecordBatch:
    """Counts and log perplexity of ``doc_id, lang, text``."""
    ids, langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
    rows = [None] * len(ids)
    scorers.bound()
    for lang, at in charmodel.by_language(langs).items():
        split = [utf8(texts[i]).split() for i in at]
        total, lettered = scorers[lang](split, np.array([charmodel.fold_of(texts[i]) for i in at]), FOREIGN)
        for i, words, value, n in zip(at, split, total.tolist(), lettered.tolist()):
            text = texts[i]
            chars = len(text) - sum(map(text.count, _WHITE))
            copy = int.from_bytes(blake2b(utf8(text), digest_size=8).digest(), "big", signed=True)
            rows[i] = (ids[i], lang, len(words), chars, sum(map(text.count, _SYMBOLS)), repeated_lines(text), repeated_words(words), n, -value / max(1, n) if words else None, copy)
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(_SCORES.values())], names=[*_SCORES])


def scored(rows: DataFrame) -> DataFrame:
    """The counts of each document of ``doc_id, lang, text``, its words with a letter or digit, and its log perplexity for each of them.

    Models of up to MODEL_ROWS rows in all are sent to every worker. Larger ones stay in tables: documents are packed into parts, and
    each part is joined with the rows of its own grams. Both ways give the same.
    """
    counts = charmodel.written(charmodel.counted(rows), "counts")
    logs = charmodel.written(charmodel.logs_of(charmodel.scored_grams(counts)), "logs")
    if logs.count() <= MODEL_ROWS:
        shared = rows.sparkSession.sparkContext.broadcast(charmodel.models_of(logs.toArrow()))

        def run(batches):
            scorers = charmodel.Scorers(shared.value)
            for batch in slices(batches):
                if batch.num_rows:
                    yield _measured(batch, scorers)

        return rows.select("doc_id", "lang", "text").mapInArrow(run, _SCHEMA)
    parts = charmodel.dealt(rows)
    answers = charmodel.asked(parts).join(logs, ["lang", "gram"])

    def run_part(packed: pa.Table, answers: pa.Table) -> pa.Table:
        scorers = charmodel.Scorers(charmodel.models_of(answers) if answers.num_rows else {})
        held = [b for p in packed.column("packed") for b in charmodel.unpacked(p.as_py())]
        return pa.Table.from_batches([_measured(b, scorers) for b in held], pa.schema(_SCORES.items()))

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run_part, _SCHEMA)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity``.

    ``base_failed``: fewer than LEAST_WORDS words, or over a fifth of the words in repeated windows.
    ``kept``: not base_failed, and log perplexity within the band of the language.
    Bands come from the quartiles of the distinct texts that pass the counting rules, of the distance to the
    language's median in standard deviations expected at the document's length: BELOW and ABOVE interquartile ranges beyond them; a language whose quartiles coincide rejects only what lies outside that one value. Null and
    empty texts have no words, fail, and have no perplexity. A null language counts as ``other``. Null ids and
    repeated rows give a row each; an empty table gives no rows; other columns are not read.
    """
    rows = _named(docs, None, id_col, lang_col, text_col)
    part, whole = MOST_REPEATED
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * whole > F.col("n_words") * part)
    out = materialize(scored(rows).withColumn("base_failed", failed), "scores")
    passing = out.filter("not base_failed")
    # Each distinct passage counts once.
    passing = passing.dropDuplicates(["lang", "copy"])
    quarter = lambda c, *q: F.percentile_approx(c, F.array(*map(F.lit, q)), F.lit(10_000))
    middle = passing.groupBy("lang").agg(quarter("log_perplexity", 0.5)[0].alias("median"), quarter("n_lettered", 0.5)[0].alias("usual"))
    # Variance at n words is fixed + by_word / n, from the quartiles of the shorter and the longer half.
    halves = passing.join(middle, "lang").groupBy("lang", (F.col("n_lettered") > F.col("usual")).alias("long")).agg(quarter("log_perplexity", 0.25, 0.75).alias("h"), F.avg(1 / F.greatest(F.col("n_lettered"), F.lit(1))).alias("inverse"))
    spread = F.pow((F.col("h")[1] - F.col("h")[0]) / NORMAL, 2)
    side = lambda c, long: F.max(F.when(F.col("long") == long, c))
    sides = halves.groupBy("lang").agg(side(spread, False).alias("v_short"), side(spread, True).alias("v_long"), side(F.col("inverse"), False).alias("i_short"), side(F.col("inverse"), True).alias("i_long"))
    slope = F.greatest(F.lit(0.0), (F.col("v_short") - F.col("v_long")) / (F.col("i_short") - F.col("i_long")))
    by_word = F.least(F.coalesce(slope, F.lit(0.0)), F.coalesce(F.col("v_long") / F.col("i_long"), F.lit(0.0)))
    fixed = F.coalesce(F.col("v_long") - by_word * F.col("i_long"), F.col("v_short"))
    shape = middle.join(sides.select("lang", by_word.alias("by_word"), fixed.alias("fixed")), "lang")
    expected = F.sqrt(F.col("fixed") + F.col("by_word") / F.greatest(F.col("n_lettered"), F.lit(1)))
    away = F.col("log_perplexity") - F.col("median")
    placed = out.join(shape, "lang", "left").withColumn("drawn", F.when(expected > 0, away / expected).otherwise(away))
    quartiles = placed.filter("not base_failed").dropDuplicates(["lang", "copy"]).groupBy("lang").agg(quarter("drawn", 0.25, 0.75).alias("q"))
    reach = F.col("q")[1] - F.col("q")[0]
    bands = quartiles.select("lang", (F.col("q")[0] - BELOW * reach).alias("low"), (F.col("q")[1] + ABOVE * reach).alias("high"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("drawn").between(F.col("low"), F.col("high")), F.lit(False))
    return placed.join(bands, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_perplexity", "drawn", "lang", "low", "high"
    )
