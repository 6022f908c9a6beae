"""Quality classifier: kernel ridge on document statistics by random Fourier features, with isotonic calibration.

Statistics of whole texts are mapped to random cosines whose inner products approximate a Gaussian
kernel. Each partition adds up its part of the normal equations, one set for each fold; their
sums are all the driver sees. Leave-one-fold-out solutions score the training rows for the
isotonic fit, the solution over all folds scores documents.
"""

from __future__ import annotations

import unicodedata
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import materialize, slices, utf8

#: Random features, and the ridge for each training row.
COSINES, RIDGE = 256, 1e-3
FOLDS = 4
#: Labelled rows that a fit takes at most, chosen by a hash of their id.
MOST_LABELLED = 200_000
#: Bins of scores for the isotonic fit.
BINS = 2000
THRESHOLD = 0.3

_CLASSES = 12
_table: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _table
    if _table is None:
        def kind(p: int) -> int:
            c = chr(p)
            if c == "\n":
                return 0
            if c.isspace():
                return 1
            if c in ".,":
                return 2
            if c in "!?":
                return 3
            if c in "#*$%&":
                return 4
            if c in "|<>":
                return 5
            k = unicodedata.category(c)
            return {"Lu": 6, "Lt": 6, "Ll": 7, "Nd": 9, "Nl": 9, "No": 9}.get(k, 8 if k[0] in "LM" else 10 if k[0] == "P" else 11)

        _table = np.array([kind(p) for p in range(0x10000)], np.uint8)
    return _table


NAMES = ["log_words", "word_length", "newlines", "spaces", "stops", "shouts", "signs", "bars", "capitals", "small", "letters", "digits", "marks", "rest", "distinct", "again", "lines_again", "line_words", "packed", "longest"]


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES; all 0 for null, empty and white texts."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(_classes()[np.minimum(points, 0xFFFF)], minlength=_CLASSES) / len(points)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)), min(50.0, len(points) / n), *share.tolist(),
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        len(zlib.compress(raw, 1)) / (len(raw) + 20), float(np.log1p(max(map(len, words)))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` for each row."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    solutions: np.ndarray  # one without each fold, then one over all
    steps: np.ndarray  # raw scores and the calibrated values there
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Random features of rows of statistics, with the standardized statistics and a constant beside them."""
        d = len(self.mean)
        draw = np.random.default_rng(7)
        directions, phases = draw.normal(size=(d, COSINES)) / np.sqrt(d), draw.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2.0 / COSINES) * np.cos(z @ directions + phases), z / np.sqrt(d), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, fold: int = FOLDS) -> np.ndarray:
        return self.cosines(x) @ self.solutions[fold]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score keeps the order inside a step."""
        if not len(x):
            return np.empty(0)
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.steps, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centres and values of the rising steps that fit ``total / weight`` best."""
    blocks: list[list[float]] = []
    for a, w, t in zip(at.tolist(), weight.tolist(), total.tolist()):
        blocks.append([a * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            s, w1, t1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w1, blocks[-1][2] + t1]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", held_out: tuple[int, int] = (5, 0)) -> QualityModel:
    """Fit on the rows of ``feats`` that ``labels`` marks 0 or 1 and whose crc32(id) mod ``held_out[0]`` is not ``held_out[1]``.

    At most some MOST_LABELLED rows take part, chosen by a hash of their id. Labels that are null or other
    than 0 and 1 are ignored; without any labelled row every score is 0.5.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(crc % held_out[0] != held_out[1])
    n = marked.count()
    if n > MOST_LABELLED:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MOST_LABELLED / n))
    rows = materialize(feats.join(marked, "doc_id").select("x", "y", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    d = len(NAMES)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)], *[F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(d)]).first()
    if not sums.n:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros((FOLDS + 1, COSINES + d + 1)), np.array([0.0]), np.array([0.5]))
    mean = np.array([sums[f"s{i}"] for i in range(d)]) / sums.n
    spread = np.sqrt(np.maximum(0, np.array([sums[f"q{i}"] for i in range(d)]) / sums.n - mean**2))
    model = QualityModel(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros((FOLDS + 1, COSINES + d + 1)), np.array([0.0]), np.array([0.5]))

    def parts(batches):
        width = COSINES + d + 1
        sums = np.zeros((FOLDS, width, width + 1))
        for batch in slices(batches):
            if batch.num_rows:
                z = model.cosines(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d))
                y, fold = np.asarray(batch.column(1)), np.asarray(batch.column(2))
                for f in range(FOLDS):
                    own = fold == f
                    sums[f, :, :width] += z[own].T @ z[own]
                    sums[f, :, width] += z[own].T @ y[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(FOLDS), width), pa.int32()), pa.array(np.tile(np.arange(width), FOLDS), pa.int32()), pa.array(list(sums.reshape(FOLDS * width, width + 1)), pa.list_(pa.float64()))], names=["fold", "line", "part"])

    def add(key, group):
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "line": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([np.sum(np.array(group["part"].to_pylist()), axis=0)], pa.list_(pa.float64()))})

    lines = rows.select("x", "y", "fold").coalesce(64).mapInArrow(parts, "fold int, line int, part array<double>").groupBy("fold", "line").applyInArrow(add, "fold int, line int, part array<double>").collect()
    width = COSINES + d + 1
    equations = np.zeros((FOLDS, width, width + 1))
    for r in lines:
        equations[r.fold, r.line] = r.part
    whole = equations.sum(axis=0)
    for f in range(FOLDS + 1):
        e = whole - equations[f] if f < FOLDS else whole
        count = max(1.0, e[-1, width - 1])  # the constant's square sums to the number of rows
        model.solutions[f] = np.linalg.solve(e[:, :width] + (RIDGE * count + 1e-2) * np.eye(width), e[:, width])

    def binned(batches):
        for batch in slices(batches):
            if batch.num_rows:
                x, fold = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d), np.asarray(batch.column(2))
                z = model.cosines(x)
                raw = np.einsum("ij,ij->i", z, model.solutions[fold])
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * BINS / 2), -BINS, BINS).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    found = rows.select("x", "y", "fold").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).orderBy("bin").collect()
    model.steps, model.values = isotonic(np.array([(r.bin + 0.5) * 2 / BINS for r in found]), np.array([float(r.n) for r in found]), np.array([r.t for r in found]))
    return model


def score_features(feats: DataFrame, model: QualityModel, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for rows of ``features``. A null id counts as not held out."""
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            s = shared.value.score(np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return feats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").select("doc_id", F.coalesce(crc % held_out[0] == held_out[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, score, predicted``, by a model fitted on ``labels``.

    Null, empty and white texts have statistics of 0 and are scored like others. Repeated rows give a row
    each, ids that repeat train with each of their texts; null ids are scored but never train. An empty table gives no rows; other
    columns are not read.
    """
    feats = materialize(features(docs, id_col, text_col), "statistics")
    return score_features(feats, fit(feats, labels, id_col, label_col, held_out), held_out)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches THRESHOLD."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column(at).to_pylist()], np.float64)
                yield batch.filter(pa.array(shared.value.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
