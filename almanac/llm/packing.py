"""Packing into optimal length buckets.

The lengths of all documents are counted into one global histogram; dynamic
programming chooses the bucket boundaries that leave the least padding; inside a
bucket, documents form batches of a fixed token budget. Only the histogram comes
to the driver: its size is bounded (see ``length_bin``) whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.llm.common import materialize, numbered_alike

#: Lengths up to this have bins of their own; longer ones share bins of a 1/256 of their power of two.
EXACT_LENGTHS = 4096
#: Rows of a bucket that one task numbers.
ROWS_PER_LANE = 8_000


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def length_bin(length: Column) -> Column:
    """The bin of a length: itself up to EXACT_LENGTHS, then its leading nine bits, so some 256 bins for each doubling."""
    drop = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") + 0.5)) - 8).cast("int")
    return F.when(length <= EXACT_LENGTHS, length).otherwise(F.call_function("shiftleft", F.call_function("shiftright", length, drop), drop))


def best_boundaries(longest: list[int], counts: list[int], totals: list[int], n_buckets: int) -> list[int]:
    """Boundaries (largest lengths of buckets) of least padding, for bins in order of length.

    ``longest``, ``counts``, ``totals``: the largest length in each bin, its rows and
    their summed length. Padding of a bucket is rows times boundary less summed length.
    The cost obeys the quadrangle inequality, so each layer of the dynamic programme is
    filled by divide and conquer.
    """
    n = len(longest)
    if not n:
        return []
    top = np.asarray(longest, dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    k = min(n_buckets, n)
    best = top * rows[1:]  # one bucket for bins 0..i; summed lengths are the same for every choice
    choice = []
    for _ in range(1, k):
        new, cut = best.copy(), np.full(n, -1)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            js = np.arange(a, min(mid - 1, b) + 1)
            at = a
            if len(js):
                cost = best[js] + top[mid] * (rows[mid + 1] - rows[js + 1])
                at = int(js[int(np.argmin(cost))])
                if cost.min() < new[mid]:
                    new[mid], cut[mid] = cost.min(), at
            todo += [(lo, mid - 1, a, at), (mid + 1, hi, at, b)]
        choice.append(cut)
        best = new
    ends, i = [], n - 1
    for cut in reversed(choice):
        if cut[i] >= 0:  # else fewer buckets do as well
            ends.append(int(longest[i]))
            i = int(cut[i])
    return sorted([*ends, int(longest[i])])


def pack(docs: DataFrame, n_buckets: int, token_budget: int, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, bucket_len, batch_id, batch_docs, padding``.

    ``bucket_len`` is the smallest boundary that holds the document; every row of a
    batch is padded to it (``padding`` is what the row lacks). A batch holds at most
    ``token_budget // bucket_len`` rows, one at least: a document longer than the budget is
    a batch alone. ``batch_id`` is unique within its bucket, so (bucket_len, batch_id) names a batch.
    ``length`` defaults to the words of ``text``; null and empty texts have length 0
    and share the batches of boundary 0 or of the first bucket. Null ids and repeated rows are packed
    like others, and dealt to all lanes by their number among rows alike; equal lengths are taken in order of id; an empty table gives no rows; other columns are not read. Lanes of a
    bucket fill their own batches, so a lane's last batch may be part full.
    """
    length = n_words(F.col("text")) if length is None else length
    rows = materialize(numbered_alike(docs.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("n_tokens"))), "pack-lengths")
    bins = rows.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total")).orderBy("bin").collect()
    ends = best_boundaries([r.longest for r in bins], [r.n for r in bins], [r.total for r in bins], n_buckets)
    held = {e: 0 for e in ends}
    at = 0
    for r in bins:
        while r.longest > ends[at]:
            at += 1
        held[ends[at]] += r.n
    boundaries = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array(F.lit(0).cast("long"))
    lane_counts = F.create_map(*[F.lit(x) for e in ends for x in (e, max(1, -(-held[e] // ROWS_PER_LANE)))]) if ends else F.create_map(F.lit(0), F.lit(1))
    spread = F.xxhash64("doc_id", "n_tokens", "copy")
    placed = (
        rows.withColumn("bucket_len", F.element_at(F.filter(boundaries, lambda b: b >= F.col("n_tokens")), 1))
        .withColumn("capacity", F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long"))
        .withColumn("lanes", F.element_at(lane_counts, F.col("bucket_len").cast("int")).cast("long"))
        .withColumn("lane", F.pmod(spread, F.col("lanes")))
    )
    w = Window.partitionBy("bucket_len", "lane").orderBy("n_tokens", "doc_id", "copy")
    numbered = placed.withColumn("in_lane", F.floor((F.row_number().over(w) - 1) / F.col("capacity")).cast("long"))
    batch = Window.partitionBy("bucket_len", "lane", "in_lane")
    return numbered.select(
        "doc_id", "n_tokens", "bucket_len", (F.col("in_lane") * F.col("lanes") + F.col("lane")).alias("batch_id"),
        F.count(F.lit(1)).over(batch).alias("batch_docs"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
