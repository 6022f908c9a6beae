import random
import zlib

import numpy as np
import pytest

from almanac.llm import quality_model, toxicity
from tests.llm.cases import DOCS, docs

WORDS = [a + b + c for a in ("th", "an", "er", "on", "wa", "li") for b in ("the", "in", "ore", "al") for c in ("", "s", "ed", "ing")]


def labelled(seed, n=500):
    """Plain prose, shouted symbol text of bad quality, and prose with insults, some of them obscured."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randint(20, 150))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(draw.randint(1, 3)):
                words.insert(draw.randrange(len(words)), draw.choice(["blockhead", "nitwit", "scoundrel"]))
        if bad:
            words = [w.upper() + draw.choice(["!!", "###", "$$$"]) for w in words]
        rows.append((i, " ".join(words) + ".", "en", "a"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out(spark, which):
    rows, labels = labelled(1)
    frame = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS y", "'clash' AS fold")
    module, mod, left = (quality_model, 5, 0) if which == "quality" else (toxicity, 4, 2)
    out = module.classify(docs(spark, rows + [(5000, None, "en", "a"), (5001, "", "en", "a"), (None, "nothing here", "en", "a")]), frame).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    truth = {i: (q if which == "quality" else t) for i, q, t in labels}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == left)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert auc(np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])) > 0.98
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    if which == "toxic":
        model = toxicity.fit(docs(spark, rows), frame)
        insults = ["nitwit", "n.i.t.w.i.t", "nit-wit", "BLOCKHEAD!", "scou*ndrel", "and then n i t w i t said", "and n. i. t. w. i. t. said", "the nit wit said", "the nit  wit said", "the n  i  t  w  i  t said", "the nit\nwit said"]
        p = toxicity._Scorer(model)([*insults, *WORDS[:20], "and then he said", None, ""])
        assert p[: len(insults)].min() > 0.3 > p[len(insults) :].max()


def test_a_family_of_insults_in_each_of_two_languages(spark):
    """Insults are a stem with any syllable after it; in the second language the stem is made of frequent syllables and stands in clean texts too."""
    draw = random.Random(6)
    plain = {"en": ["the", "in", "ore", "al", "er", "on", "wa", "li", "th", "an"], "xx": ["ung", "lich", "ver", "keit", "ein", "schaf", "ber", "heit", "tum", "ge"]}
    stem = {"en": "zoqu", "xx": "keitver"}
    rows, labels = [], []
    for i in range(900):
        lang = "en" if i % 3 else "xx"
        word = lambda: "".join(draw.choice(plain[lang]) for _ in range(draw.randint(1, 4)))  # noqa: B023, E731
        words = [word() for _ in range(draw.randint(40, 200))]
        toxic = draw.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words[draw.randrange(len(words))] = stem[lang] + draw.choice(plain[lang])
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + ".", lang, "a"))
        labels.append((i, 1, int(toxic)))
    out = toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for lang in plain:
        held = [r for r in out if r.held_out and rows[r.doc_id][2] == lang]
        assert auc(np.array([r.score for r in held]), np.array([labels[r.doc_id][2] for r in held])) > 0.95


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_edges(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = module.classify(docs(spark), none).collect()
    assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
    few = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (7, 0, 0), (9, 1, 0), (11, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert module.classify(docs(spark), few).count() == len(DOCS)
    assert module.classify(docs(spark, []), few).count() == 0


def test_isotonic_is_the_best_rising_fit():
    draw = np.random.default_rng(0)
    for _ in range(20):
        n = 12
        w, y = draw.integers(1, 5, n).astype(float), draw.random(n)
        at, value = quality_model.isotonic(np.arange(n, dtype=float), w, w * y)
        assert (np.diff(value) > 0).all()
        # Min-max formula of isotonic regression.
        mean = lambda i, j: (w[i : j + 1] * y[i : j + 1]).sum() / w[i : j + 1].sum()
        best = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert sorted({round(b, 9) for b in best}) == sorted({round(v, 9) for v in value})


def test_cosines_approximate_the_gaussian_kernel():
    d = len(quality_model.NAMES)
    model = quality_model.QualityModel(np.zeros(d), np.ones(d), np.zeros((5, quality_model.COSINES + d + 1)), np.array([0.0]), np.array([0.5]))
    x = np.random.default_rng(1).normal(size=(30, d))
    z = model.cosines(x)[:, : quality_model.COSINES]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.3


def plain_kernel(s, t, p=toxicity.LENGTH, decay=toxicity.DECAY):
    """Every pair of equal subsequences, one by one."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] != 0 for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    words = ["idiot", "i.diot", "diot", "the", "a", "éclat", "xx"]
    coded = [toxicity._coded([w])[0].tolist() for w in words]
    size = np.concatenate([toxicity.norms(toxicity._coded([w])) for w in words])
    want = np.array([[plain_kernel(a, b) for b in coded] for a in coded])
    assert np.allclose(size**2, np.diag(want), rtol=1e-4)
    got = toxicity.project(words, toxicity.landmark_columns(words))
    assert np.allclose(got, want / np.sqrt(np.outer(np.diag(want), np.diag(want))), atol=1e-4)


def prefix_norms(coded):
    """Roots of the kernel of each word with itself, by the recursion over prefixes."""
    n, size = coded.shape
    match = [[(coded[:, a] == coded[:, b]) & (coded[:, a] > 0) for b in range(size)] for a in range(size)]
    d, under = toxicity.DECAY, np.ones((size + 1, size + 1, n), np.float32)
    for _ in range(toxicity.LENGTH - 1):
        over = np.zeros_like(under)
        for a in range(1, size + 1):
            run = np.zeros(n, np.float32)
            for b in range(1, size + 1):
                run = d * run + d * d * match[a - 1][b - 1] * under[a - 1, b - 1]
                over[a, b] = d * over[a - 1, b] + run
        under = over
    return np.sqrt(sum(d * d * match[a][b] * under[a, b] for a in range(size) for b in range(size)))


def plain_facts(model, texts):
    """The features of each text, word by word of its sentences."""
    split = [[w for w in map(toxicity.words_of, toxicity.sentences_of(t)) if w] if t else [] for t in texts]
    bare = {w: w.strip(toxicity._EDGE).lower() for doc in split for words in doc for w in words}
    parts = sorted({p for w in bare.values() for p in toxicity._windows(w)})
    margin = {}
    for at in toxicity._by_length(parts):
        coded = toxicity._coded([parts[i] for i in at])
        total = sum((weight * model.weights[code] for weight, code in toxicity._triples(coded)), np.zeros(len(at), np.float32))
        size = prefix_norms(coded)
        margin.update((parts[i], m + model.bias - toxicity.SPLIT * (" " in parts[i])) for i, m in zip(at, (total / np.where(size > 0, size, 1)).tolist()))
    of = {w: max(margin[p] for p in toxicity._windows(x)) for w, x in bare.items()}
    return np.array([toxicity.features(np.array([max(of[w] for w in words) for words in doc]), sum(map(len, doc))) for doc in split]).reshape(-1, 3)


def some_model():
    rows, labels = labelled(4, 120)
    return toxicity.train([t for _, t, *_ in rows], [toxic for *_, toxic in labels])


def test_scorer_has_the_sentences_and_windows_of_every_text(monkeypatch):
    draw, model = random.Random(8), some_model()
    signs = [*"abnitw.!?-_*#'\" é\n\t\x1c　İß1٣", *[" "] * 10]
    texts = [None, "", " \n", "n i t w i t", " n    i    t ", "a. b. c.", "a b  c    d e f g. hh! i j k abc. n i t", "nitwit" * 500, "(((", "- b - c"]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 300))) for _ in range(500)]
    want = model.probability(plain_facts(model, texts))
    assert np.allclose(toxicity._Scorer(model)(texts), want, atol=1e-5)
    monkeypatch.setattr(toxicity, "WORDS_HELD", 50)
    scorer = toxicity._Scorer(model)
    parts = np.concatenate([scorer(texts[i : i + 7]) for i in range(0, len(texts), 7)])
    # A score hangs neither on the texts beside it nor on what was forgotten.
    assert (parts == toxicity._Scorer(model)(texts)).all() and len(toxicity._Scorer(model)([])) == 0


def test_scoring_takes_well_under_the_time_of_the_plain_way():
    from time import process_time

    draw, model = random.Random(9), some_model()
    word = lambda: "".join(draw.choice(["th", "er", "ung", "lich", "ó", "que", "en", "ab", "r", "st", "i", "ma"]) for _ in range(draw.randint(1, 5)))
    texts = [". ".join(" ".join(word() for _ in range(9)) for _ in range(30)) + "." for _ in range(300)]
    took = {}
    for name, f in (("numbers", lambda: toxicity._Scorer(model)(texts)), ("plain", lambda: model.probability(plain_facts(model, texts)))):
        times = []
        for _ in range(3):
            began = process_time()
            f()
            times.append(process_time() - began)
        took[name] = min(times)
    assert took["numbers"] < 0.65 * took["plain"], took
