import random
import re

import numpy as np
import pytest

from almanac.llm import minhash
from tests.llm.cases import docs


def brute(rows, words, part=80, whole=100):
    """Set sizes and components by comparing all pairs."""
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(w)} if 0 < len(w) < words else set(zip(*(w[j:] for j in range(words)))))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)), key=str)


def answer(spark, rows, words):
    out = minhash.near_duplicates(docs(spark, rows), words).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def test_edges(spark):
    from tests.llm.cases import DOCS

    assert answer(spark, DOCS, 2) == brute(DOCS, 2)
    assert answer(spark, [], 2) == []


@pytest.mark.parametrize("words", [2, 5])
def test_chains_and_groups(spark, words):
    """Copies, a chain whose ends are unlike, and a dense group around the threshold, in which hubs alone miss links."""
    draw = random.Random(words)
    vocab = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocab) for _ in range(120)]
    rows, i = [], 0

    def add(w):
        nonlocal i
        i += 1
        rows.append((i, " ".join(w), "en", "a"))

    for _ in range(60):
        w = list(base)
        for _ in range(draw.randint(0, 12)):
            w[draw.randrange(len(w))] = draw.choice(vocab)
        add(w)
    w = [draw.choice(vocab) for _ in range(100)]
    for _ in range(40):
        w = list(w)
        w[draw.randrange(len(w))] = draw.choice(vocab)
        add(w)
    for _ in range(30):
        add([draw.choice(vocab) for _ in range(draw.randint(1, 60))])
    for _ in range(10):
        add(base)
    draw.shuffle(rows)
    assert answer(spark, rows, words) == brute(rows, words)


def test_blocks_find_what_pairs_find():
    draw = random.Random(2)
    sets = [np.unique(np.array([draw.randint(0, 400) for _ in range(draw.randint(1, 60))], np.uint32)) for _ in range(60)] + [np.arange(50, dtype=np.uint32) + k for k in range(8)]
    rows = [(i, i, s.tobytes()) for i, s in enumerate(sets)]
    found = minhash._close_pairs(rows, rows, 0.8, {})
    for a, b in found:
        inter = len(np.intersect1d(sets[a], sets[b]))
        assert inter / (len(sets[a]) + len(sets[b]) - inter) >= 0.79
    root = {i: i for i in range(len(sets))}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in found:
        root[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if inter >= 0.8 * (len(sets[a]) + len(sets[b]) - inter):
                assert find(a) == find(b)


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs(spark), 2, (70, 100))


def test_prefixes_leave_no_candidate_out(spark):
    """Nodes with MATCHES tokens in common share a posted token, and nodes without such a partner may be left out."""
    draw = np.random.default_rng(4)
    marks = draw.integers(-3, 3, (12, minhash.COORDINATES)).repeat(20, axis=0)
    change = draw.random(marks.shape) < np.linspace(0, 0.6, len(marks))[:, None]
    marks[change] = draw.integers(-(1 << 31), 1 << 31, int(change.sum()))
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(marks.tolist())], "node long, marks array<int>")
    posted = {r.node: set(r.tokens) for r in minhash.prefixes(frame).collect()}
    assert all(len(t) <= minhash.COORDINATES - minhash.MATCHES + 1 for t in posted.values()) and len(posted) < len(marks)
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] == marks[b]).sum() >= minhash.MATCHES:
                assert posted[a] & posted[b]


def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """A group twice as large has less than 2.5 times the rows in lists and blocks."""
    draw = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    base = [draw.choice(vocab) for _ in range(100)]

    def made(n):
        counts, plain, blocks = [], minhash.materialize, minhash._blocks

        def counted(df, name):
            out = plain(df, name)
            counts.append(out.count())
            return out

        def dealt(members, data, compare):
            counts.append(members.agg({"n_rest": "sum", "n_all": "sum"}).selectExpr("`sum(n_rest)` + `sum(n_all)` AS n").first().n or 0)
            return blocks(members, data, compare)

        rows = []
        for i in range(n):
            w = list(base)
            for _ in range(draw.randint(0, 25)):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            rows.append((i, " ".join(w), "en", "a"))
        with monkeypatch.context() as patch:
            patch.setattr(minhash, "materialize", counted)
            patch.setattr(minhash, "_blocks", dealt)
            minhash.near_duplicates(docs(spark, rows), 2).collect()
        return sum(counts)

    assert made(300) < 2.5 * made(150)
