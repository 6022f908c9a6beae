import itertools
import random

from almanac.llm import common, packing, sharding
from tests.llm.cases import DOCS, docs


def test_shards_fit_and_split_only_when_needed(spark):
    rows = [(i, "x" * random.Random(i).randint(0, 400), "en", "a") for i in range(400)] + [(5000, "y" * 3000, "en", "a")]
    out = sharding.assign_shards(docs(spark, rows), 1000).collect()
    assert len(out) == len(rows)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
        assert len(r.shard) == r.depth
    for name, members in shards.items():
        size = sum(m.n_bytes for m in members)
        assert size <= 1000 or len(members) == 1
        assert {(m.shard_bytes, m.shard_docs) for m in members} == {(size, len(members))}
        if name:  # its parent was too large
            parent = [r for r in out if r.shard.startswith(name[:-1])]
            assert sum(m.n_bytes for m in parent) > 1000 and len(parent) > 1
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in itertools.permutations(names, 2))


def test_shard_edges(spark):
    out = sharding.assign_shards(docs(spark), 50).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in DOCS)
    assert {r.copy for r in out if r.doc_id == 7} == {0, 1}
    assert next(r for r in out if r.doc_id == 4).n_bytes == 0
    assert sharding.assign_shards(docs(spark, []), 50).count() == 0
    same = [(1, "aaaaaaaaaa", "en", "a")] * 300
    out = sharding.assign_shards(docs(spark, same), 100).collect()
    assert len(out) == 300 and max(r.shard_bytes for r in out) <= 100


def _padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    for seed in range(30):
        draw = random.Random(seed)
        lengths = [draw.randint(0, 25) for _ in range(draw.randint(1, 40))]
        bins = sorted(set(lengths))
        for k in (1, 2, 3, 5):
            ends = packing.best_boundaries(bins, [lengths.count(b) for b in bins], [b * lengths.count(b) for b in bins], k)
            best = min(_padding(lengths, [*c, bins[-1]]) for j in range(k) for c in itertools.combinations(bins[:-1], min(j, len(bins) - 1)))
            assert len(ends) <= k and ends[-1] == bins[-1]
            assert _padding(lengths, ends) == best
    assert packing.best_boundaries([], [], [], 4) == []


def test_batches(spark):
    out = packing.pack(docs(spark), 4, 40).collect()
    assert len(out) == len(DOCS)
    batches = {}
    for r in out:
        assert r.n_tokens + r.padding == r.bucket_len
        batches.setdefault((r.bucket_len, r.batch_id), []).append(r)
    for (size, _), members in batches.items():
        assert len(members) == members[0].batch_docs and (len(members) * size <= 40 or len(members) == 1)
    assert packing.pack(docs(spark, []), 4, 40).count() == 0
    words = {1: 15, 4: 0, 6: 0, 9: 120_000}
    assert {r.doc_id: r.n_tokens for r in out if r.doc_id in words} == words


def test_long_lengths_share_bins(spark):
    from pyspark.sql import functions as F

    got = spark.range(1, 40_000_000, 9973).select("id", packing.length_bin(F.col("id")).alias("bin"))
    bad = got.filter((F.col("bin") > F.col("id")) | (F.col("id") - F.col("bin") > F.col("id") / 250)).count()
    assert bad == 0 and got.select("bin").distinct().count() < 5000


def test_many_rows_alike(spark):
    n = 3 * common.ALIKE_ROWS + 5
    alike = spark.range(n).selectExpr("cast(null as bigint) AS doc_id", "'' AS text", "7 AS copy")
    out = sharding.assign_shards(alike, 1_000_000).selectExpr("count(*) AS n", "count(distinct copy) AS copies", "max(copy) AS top").first()
    assert (out.n, out.copies, out.top) == (n, n, n - 1)
    words = spark.range(4 * packing.ROWS_PER_LANE).selectExpr("1L AS doc_id", "'a b c' AS text")
    out = packing.pack(words, 2, 30).groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in out) == 4 * packing.ROWS_PER_LANE and max(r["count"] for r in out) == 10
    assert {r.batch_id % 4 for r in out} == {0, 1, 2, 3}
