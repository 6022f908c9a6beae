"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, long ones first, and buckets cut into blocks.
A first pass over the block of the longest vectors gives every query a score that its answers must
reach. For each query and block that score becomes a local cosine threshold,
score / (length of query * greatest length in the block): above 1 the block is skipped. Queries of like
need (score / length) are packed together, and a pair of blocks whose longest vector is below the least need is never
made: the join drops it before anything is shuffled. From COORDINATE_FROM on, vectors are pruned by the interval that the query's largest
coordinates leave them; below, by their length alone. Products of what is left are
verified exactly, in integers. Queries travel in blocks too, and a pair of blocks is
a row: work is spread by pairs, and no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from almanac.llm.common import materialize

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
MAX_BUCKETS = 64
#: Local cosine threshold from which coordinates prune, and how many of them are looked at.
COORDINATE_FROM, FOCUS = 0.6, 6
#: Guard for rounding in bounds; products are exact.
SLACK = 1e-9

#: The need of a query that no vector can meet.
NEVER = 1e300

_BLOCK = "block long, dim int, longest double, need double, ids binary, ints binary, floors binary"


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, dim, norm, ints``: floor(scale * x) of each component as 64-bit integers.

    Rows with a null id, a null vector, or null or non-finite components are left out, and so are
    vectors with a component that is beyond 64 bits once scaled.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            values = lists.flatten()
            missing = values.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64))
                bad = missing | ~(np.abs(x) < 2.0**63)
            x = np.where(bad, 0.0, x).astype(np.int64)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            norms = np.zeros(len(ends) - 1)
            full = np.flatnonzero(np.diff(ends))
            if len(full):
                norms[full] = np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, ends[full]))
            packed = pa.Array.from_buffers(pa.large_binary(), len(norms), [None, pa.py_buffer(ends * 8), pa.py_buffer(x)]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(norms, pa.float64()), packed], names=["vec_id", "dim", "norm", "ints"])
            yield out.filter(pa.array(wrong[ends[1:]] == wrong[ends[:-1]]))

    return rows.mapInArrow(run, "vec_id long, dim int, norm double, ints binary")


def _pack(key, rows):
    """One block of a group, its vectors from longest to shortest, with the greatest length and the least need in it."""
    rows = rows.sort_by([("norm", "descending"), ("vec_id", "ascending")])
    joined = [np.asarray(rows["vec_id"], dtype=np.int64).tobytes(), b"".join(rows["ints"].to_pylist()), np.asarray(rows["floor"], dtype=np.float64).tobytes()]
    head = [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([rows["norm"][0].as_py()], pa.float64()), pa.array([min(rows["need"].to_pylist())], pa.float64())]
    return pa.table([*head, *[pa.array([x], pa.binary()) for x in joined]], names=["block", "dim", "longest", "need", "ids", "ints", "floors"])


def _blocks(rows: DataFrame, value: str, size: int, name: str) -> tuple[DataFrame, dict[int, int], int]:
    """Blocks of some ``size`` rows that are alike in ``value``, greatest first; the first block of each dimension; the number of blocks.

    Rows are dealt to the blocks of a bucket by id and vector and by their number, so no id fills a block.
    """
    n = rows.count()
    n_buckets = max(1, min(MAX_BUCKETS, -(-n // size)))
    cuts = rows.approxQuantile(value, [i / n_buckets for i in range(1, n_buckets)], 0.25 / n_buckets) if n and n_buckets > 1 else []
    bucket = F.lit(0)
    for cut in cuts:
        bucket = bucket + F.when(F.col(value) < cut, 1).otherwise(0)
    placed = rows.withColumn("bucket", bucket)
    counts = {(r.bucket, r.dim): r["count"] for r in placed.groupBy("bucket", "dim").count().collect()}
    starts, at = {}, 0
    for key in sorted(counts):
        starts[key] = at
        at += -(-counts[key] // size)
    first: dict[int, int] = {}
    for b, d in sorted(counts):
        first.setdefault(d, starts[b, d])
    layout = rows.sparkSession.createDataFrame([(b, d, starts[b, d], -(-counts[b, d] // size)) for b, d in counts], "bucket int, dim int, start long, parts long")
    dealt = placed.join(layout, ["bucket", "dim"]).withColumn("block", F.col("start") + F.pmod(F.xxhash64("vec_id", "row"), F.col("parts")))
    return materialize(dealt.select("block", "dim", "vec_id", "norm", "need", "floor", "ints").groupBy("block", "dim").applyInArrow(_pack, _BLOCK), name), first, at


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products; in doubles where none can exceed their whole numbers."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    return q @ p.T


def search_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The ``k`` best of one block for each query, of those that reach the query's ``floor`` (-inf: no floor yet). Vectors come from longest to shortest."""
    lengths = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
    q_lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    longest = lengths[0] if len(lengths) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(floor > 0, floor / (q_lengths * longest), -1.0)
    live = ~(local > 1 + SLACK)
    # Length pruning: a vector must be as long as floor / length of the query.
    need = np.where((floor > 0) & live, floor / np.maximum(q_lengths, 1e-300), 0.0) * (1 - SLACK)
    upto = np.searchsorted(-lengths, -need, side="right")
    found: list[tuple[int, int, int]] = []

    def keep(row: int, at: np.ndarray, score: np.ndarray) -> None:
        ok = (p_ids[at] != q_ids[row]) & (score >= floor[row])
        at, score = at[ok], score[ok]
        if len(at) > k:
            worst = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= worst], score[score >= worst]
        best = np.lexsort((p_ids[at], -score))[:k]
        found.extend((int(q_ids[row]), int(p_ids[at[b]]), int(score[b])) for b in best)

    by_coordinate = live & (local >= COORDINATE_FROM) if q.shape[1] else np.zeros(len(q), bool)
    by_length = np.flatnonzero(live & ~by_coordinate)
    for at in range(0, len(by_length), 256):
        group = by_length[at : at + 256]
        reach = int(upto[group].max(initial=0))
        products = _products(q[group], p[:reach])
        for row, score in zip(group, products):
            keep(row, np.arange(upto[row]), score[: upto[row]])
    if by_coordinate.any():
        unit = p / np.maximum(lengths, 1e-300)[:, None]
        for row in np.flatnonzero(by_coordinate):
            x = q[row] / q_lengths[row]
            t = min(1.0, local[row])
            focus = np.argsort(-np.abs(x))[:FOCUS]
            ok = np.arange(upto[row])
            for f in focus:
                # cos >= t: with angles a of x to axis f and b of the vector to it, |a - b| <= acos(t).
                a, width = np.arccos(np.clip(x[f], -1, 1)), np.arccos(np.clip(t, -1, 1))
                high, low = np.cos(max(0.0, a - width)), np.cos(min(np.pi, a + width))
                y = unit[ok, f]
                ok = ok[(y <= high + SLACK) & (y >= low - SLACK)]
            keep(row, ok, _products(q[row : row + 1], p[ok])[0])
    return found


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Rows ``q_ids, q_ints, floors, dim, ids, ints`` to ``query_id, vec_id, score``."""

    def run(batches):
        for batch in batches:
            for q_ids, q_ints, floors, dim, ids, ints in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_ints", "floors", "dim", "ids", "ints"))):
                a, b = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                found = search_block(a, np.frombuffer(q_ints, np.int64).reshape(len(a), dim), np.frombuffer(floors, np.float64), b, np.frombuffer(ints, np.int64).reshape(len(b), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q_ints", "floors", "dim", "ids", "ints").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int, query_every: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by ``query_every``: its ``k`` highest integer inner products with vectors of other ids, as ``query_id, rank, vec_id, score``.

    Fewer than ``k`` where there are fewer candidates; ties go to the smaller id. Vectors that are
    null or hold nulls or non-finite numbers, and rows without id, take no part. Candidates of
    another dimension than the query's are not its candidates. Rows that repeat an id are candidates each, and a query id asks once for each distinct vector it has
    (answers are merged). An empty table gives no rows; other columns are not read. Scores are 64-bit and wrap beyond.
    A vector with a component that is beyond 64 bits once scaled takes no part.
    """
    rows = materialize(quantized(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "ints")
    open_floor = {"need": F.lit(0.0), "floor": F.lit(float("-inf"))}
    blocks, first, n_blocks = _blocks(rows.withColumns(open_floor), "norm", BLOCK_ROWS, "blocks")
    blocks = blocks.select("block", "dim", "longest", "ids", "ints")
    asked = rows.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "dim", "ints"])

    def query_blocks(queries: DataFrame, value: str) -> tuple[DataFrame, int]:
        packed, _, n = _blocks(queries, value, QUERY_ROWS, "queries")
        return packed.select("dim", "need", "floors", F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints")), n

    # The longest vectors of each dimension give every query its floor.
    queries, _ = query_blocks(asked.withColumns(open_floor), "norm")
    opening = queries.join(blocks.filter(F.col("block").isin(list(first.values()))), "dim")
    opened = materialize(_search(opening, k), "opening")
    floors = opened.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("vec_id", "floor")
    need = F.when(~(F.col("floor") > 0), 0.0).when(F.col("norm") > 0, F.least(F.col("floor") / F.col("norm"), F.lit(NEVER))).otherwise(NEVER)
    armed = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).withColumn("need", need)
    queries, n_queries = query_blocks(materialize(armed, "armed"), "need")
    rest = blocks.filter(~F.col("block").isin(list(first.values()))).withColumnRenamed("dim", "p_dim")
    met = queries.join(rest, (F.col("dim") == F.col("p_dim")) & (F.col("longest") >= F.col("need") * (1 - SLACK)))
    pairs = met.repartition(max(1, min(10_000, (n_blocks - len(first)) * n_queries)))
    best = opened.unionByName(_search(pairs, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
