"""Sharding by extendible hashing, in DataFrame operations only.

Every row gets a 52-bit hash. A directory, indexed by hash prefix, starts as one
bucket; a bucket that holds more than ``limit_bytes`` is split on one more bit,
and only such buckets are, so that dense regions of the hash space get longer
prefixes. The directory is worked out on byte sums of fine prefixes, never on
rows: its size follows the number of shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import materialize, numbered_alike

#: Bits of the hash that can be used as a prefix.
HASH_BITS = 52
#: How far beyond the expected depth one pass of the directory looks.
EXTRA_BITS = 5


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy, n_bytes, hash`` of each row. Rows alike in id and size are numbered by ``copy``, so each has a hash of its own."""
    each = numbered_alike(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("#"), F.col("n_bytes").cast("string"), F.lit(":"), F.col("copy").cast("string"))
    return each.withColumn("hash", F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long"))


def _directory(rows: DataFrame, low: int, high: int, limit_bytes: int) -> DataFrame:
    """For each prefix of ``high`` bits: the leaf that covers it, at a depth of ``low`` or more, or null where even ``high`` bits leave too much.

    A bucket is a leaf if it fits and its parent doesn't. Buckets meet their parents, one
    each, and a leaf is spread over the prefixes it covers, which are as many in all as there are prefixes.
    """
    fine = rows.groupBy(F.shiftright("hash", HASH_BITS - high).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    levels = fine.select("b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "fine").withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
    buckets = materialize(levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")), "shard-buckets")
    fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1)
    parents = buckets.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"), fits.alias("parent_fits"))
    leaves = buckets.filter(fits).withColumn("above", F.shiftright("prefix", 1)).join(parents, ["depth", "above"], "left").filter(~F.coalesce("parent_fits", F.lit(False)))
    first = F.expr(f"shiftleft(prefix, {high} - depth)")
    covered = leaves.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {high} - depth)") - 1)).alias("fine"), "depth", "prefix", "shard_bytes", "shard_docs")
    open_ = buckets.filter((F.col("depth") == high) & ~fits).select(F.col("prefix").alias("fine"), *[F.lit(None).cast(t).alias(c) for c, t in (("depth", "int"), ("prefix", "long"), ("shard_bytes", "long"), ("shard_docs", "long"))])
    return covered.unionByName(open_)


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, copy, n_bytes, depth, shard, shard_bytes, shard_docs``.

    ``shard`` spells the prefix in ``depth`` binary digits ('' for a directory that
    never split). No shard holds more than ``limit_bytes`` of UTF-8 unless it is one
    row that is larger by itself. A null text has 0 bytes; null ids are hashed as a
    value of their own; repeated rows are kept, each numbered by ``copy`` and hashed
    with that number; an empty table gives no rows. Other columns are not read.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    left = materialize(sized_rows(docs, id_col, text_col), "shard-rows")
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit_bytes))) + EXTRA_BITS))
    done = []
    while True:
        leaves = materialize(_directory(left, low, high, limit_bytes), "shard-directory")
        placed = left.withColumn("fine", F.shiftright("hash", HASH_BITS - high)).join(leaves, "fine").drop("fine")
        if high == HASH_BITS:  # rows that share all bits stay together
            whole = leaves.filter(F.col("depth").isNull()).count()
            if whole:
                raise ValueError(f"{whole} hash values are shared by more rows than a shard may hold")
        open_ones = leaves.filter(F.col("depth").isNull()).limit(1).count()
        done.append(placed.filter(F.col("depth").isNotNull()))
        if not open_ones:
            break
        left = placed.filter(F.col("depth").isNull()).select(left.columns)
        low, high = high + 1, min(HASH_BITS, high + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "copy", "n_bytes", F.col("depth").cast("int").alias("depth"), shard.alias("shard"), "shard_bytes", "shard_docs")
