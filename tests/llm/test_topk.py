import random

import numpy as np
import pytest

from almanac.llm import topk


def brute(rows, k, every, scale=256):
    ok = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        qs = {tuple(v) for i, v in ok if i == q}
        best = sorted(((-int(np.dot(v, u)), i) for u in qs for i, v in ok if i != q and len(v) == len(u)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def answer(spark, rows, k=5, every=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'clash' AS label", "1 AS score", "2 AS block", "3 AS dim", "4 AS norm")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, k, every).collect())


def test_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.3, None]), (2, None), (3, [float("nan"), 1.0]), (4, [0.1, 0.1]), (5, [0.1, 0.1]), (6, [0.1, 0.1]), (7, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (15, [0.0, 0.0]), (20, []), (21, []), (25, [5.0])]
    assert answer(spark, [*rows, (30, [1e300, 1.0]), (35, [1.0, -1e17]), (36, [1e308, 2.0])]) == brute(rows, 5, 5)
    assert answer(spark, rows) == brute(rows, 5, 5)
    assert answer(spark, []) == []
    assert answer(spark, [(1, [1.0])]) == []


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_many_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    draw = random.Random(3)
    hot = [draw.gauss(0, 1) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [draw.gauss(0, 1) * (1 + spread * (i % 7)) for _ in range(6)]) for i in range(400)]
    assert answer(spark, rows, every=10) == brute(rows, 5, 10)


def test_pruned_search_is_exact():
    draw = np.random.default_rng(0)
    for scale in (1, 40):
        p = draw.integers(-100, 100, (300, 8)) * draw.integers(1, scale + 1, (300, 1))
        p = p[np.argsort(-np.sqrt((p.astype(float) ** 2).sum(1)), kind="stable")]
        q = np.vstack([p[:20] + draw.integers(-3, 3, (20, 8)), draw.integers(-100, 100, (20, 8)), np.zeros((1, 8), int)])
        ids, q_ids = np.arange(300), np.arange(1000, 1041)
        scores = q @ p.T
        floor = np.sort(scores, axis=1)[:, -3].astype(float)
        found = topk.search_block(q_ids, q, floor, ids, p, 5)
        for r in range(len(q)):
            order = np.lexsort((ids, -scores[r]))[:5]
            want = [(int(q_ids[r]), int(i), int(scores[r, i])) for i in order if scores[r, i] >= floor[r]]
            assert [f for f in found if f[0] == q_ids[r]] == want


def test_pairs_below_the_need_are_never_made(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    made = []
    search = topk._search
    monkeypatch.setattr(topk, "_search", lambda pairs, k: made.append(pairs.count()) or search(pairs, k))
    rows = [(i, [float(400 - i), 1.0 + i % 3]) for i in range(400)]
    assert answer(spark, rows, every=20) == brute(rows, 5, 20)
    assert made[1] < 0.2 * 4 * 19


def test_one_id_in_many_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    rows = [(i % 2 * (i + 1), [1.0, float(i % 5)]) for i in range(120)]
    assert answer(spark, rows, every=7) == brute(rows, 5, 7)
