"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

Texts are cut into sentences, and sentences into windows: words, neighbours that are both short, rows of single
characters. Windows are compared by the gap-weighted subsequence kernel: every three letters in order count, less
for every letter, sign or blank between them, so an insult with letters inserted or set apart stays close to
itself. The kernel is reduced to landmark windows, spread over the kinds of insults by farthest-first choice, and a linear
machine is trained on the landmark features of witnesses (the worst windows of sentences of rejected documents) against
windows of clean sentences; witnesses are chosen anew with each machine. As the features are linear in the kernel,
the machine is one weight for each letter triple, which scores a window in one sum. A document's score is
calibrated on the margins of its worst sentences and on how often its sentences hold an insult: where an insult is made of
frequent syllables, one alone may be chance.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import slices

#: Length and decay of subsequences, letter codes, letters in a window of a long word.
LENGTH, DECAY, LETTERS, WINDOW = 3, 0.65, 64, 24
BEGIN, STOP = 62, 63
LANDMARKS = 128
#: Documents of each label that a fit takes at most, and the characters of each that it reads.
MOST_LABELLED, FIT_CHARS = 1500, 20_000
#: Windows that a fit takes from one document at most, and the worst sentences that count.
WITNESSES, WORST = 6, 3
#: Distinct words whose scores a worker holds.
WORDS_HELD = 500_000
ROUNDS = 4
#: What a window of two words loses: neighbours are an insult only if surely so.
SPLIT = 0.35
THRESHOLD = 0.3

#: Letters of a short neighbour, and rows of single characters with a sign after each perhaps.
NEAR = 4
_SPACED = re.compile(r"(?<!\S)\S[^\w\s]?(?:\s{1,3}\S[^\w\s]?){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[^\s.!?]{2}[.!?])\s+")
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_+=~/\\…«»„“”‘’"
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_table: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code of each character: 1-26 plain Latin letters, digits as the letters they are written for, 27-61 other letters, 0 what is no letter."""
    global _table
    if _table is None:
        codes = np.zeros(0x10000, np.uint8)
        for p in range(0x10000):
            c = chr(p)
            base = unicodedata.normalize("NFKC", _DIGITS.get(c, c).lower())[:1]
            if "a" <= base <= "z":
                codes[p] = ord(base) - 96
            elif unicodedata.category(c)[0] == "L":
                codes[p] = 27 + ord(base) % 35
        _table = codes
    return _table


def sentences_of(text: str) -> list[str]:
    """A text cut after full stops, exclamation and question marks; single characters with a stop each stay together."""
    return _SENTENCE.split(text)


def words_of(sentence: str) -> list[str]:
    """What is scored of a sentence: its words, short neighbours with one blank between them, and rows of single characters read as one word."""
    words = sentence.split()
    if len(words) > 1:
        sizes = [*map(len, words)]
        near = [a + " " + b for a, b, x, y in zip(words, words[1:], sizes, sizes[1:]) if x <= NEAR >= y]
        if sizes.count(1) + sizes.count(2) > 2:
            words += ["".join(m.group().split()) for m in _SPACED.finditer(sentence)]
        words += near
    return words


def _windows(word: str) -> list[str]:
    word = word.strip(_EDGE)
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _coded(words: list[str]) -> np.ndarray:
    """Codes of words of one length, with marks for both ends."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    body = np.where(points < 0x10000, _letter_table()[np.minimum(points, 0xFFFF)], 27)
    return np.hstack([np.full((len(words), 1), BEGIN), body, np.full((len(words), 1), STOP)]).astype(np.int32)


def _before(match: np.ndarray) -> np.ndarray:
    """For each pair of places the decayed sum of the matches before both."""
    rows, out = np.zeros_like(match), np.zeros_like(match)
    for a in range(1, len(match)):
        np.multiply(rows[a - 1] + match[a - 1], np.float32(DECAY), out=rows[a])
    for b in range(1, len(match)):
        np.multiply(out[:, b - 1] + rows[:, b - 1], np.float32(DECAY), out=out[:, b])
    return out


def norms(coded: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself: over equal middle letters, the matches before them times those after them.

    No sum runs over words, so that a word's norm does not depend on those beside it.
    """
    letters = np.ascontiguousarray(coded.T)
    match = ((letters[:, None] == letters) & (letters > 0)).astype(np.float32)
    inner = match * _before(match)
    inner *= _before(match[::-1, ::-1])[::-1, ::-1]
    total = np.zeros(len(coded), np.float32)
    for row in inner.reshape(-1, len(coded)):
        total += row
    return np.sqrt(np.float32(DECAY * DECAY) * total)


def _triples(coded: np.ndarray):
    """Weight and code of every subsequence of the words; a code of 0 stands for one that holds something else than letters."""
    for i, j, k in combinations(range(coded.shape[1]), LENGTH):
        a, b, c = coded[:, i], coded[:, j], coded[:, k]
        yield DECAY ** (k - i + 1), np.where((a > 0) & (b > 0) & (c > 0), (a * LETTERS + b) * LETTERS + c, 0)


def _sums(coded: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum over the triples of each word of one weight for each triple; those of equal span are added up before they decay."""
    letters = np.ascontiguousarray(coded.T, np.intp)
    first, middle = letters * LETTERS**2, letters * LETTERS
    total = np.zeros(len(coded), np.float32)
    for span in range(LENGTH - 1, len(letters)):
        alike = np.zeros(len(coded), np.float32)
        for i in range(len(letters) - span):
            for row in weights.take(middle[i + 1 : i + span] + (first[i] + letters[i + span])):
                alike += row
        total += np.float32(DECAY ** (span + 1)) * alike
    return total


def _by_length(words: list[str], most: int = 20_000):
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for size, at in groups.items():
        step = max(500, most * 12 // (size + 2))
        for j in range(0, len(at), step):
            yield at[j : j + step]


def project(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Inner products of the normalized words with columns of triple weights (``LETTERS ** 3`` rows)."""
    out = np.zeros((len(words), *weights.shape[1:]), np.float32)
    if weights.ndim == 1:  # triples with anything else than letters weigh nothing
        weights = weights.reshape(LETTERS, LETTERS, LETTERS).copy()
        weights[0] = weights[:, 0] = weights[:, :, 0] = 0
        weights = weights.reshape(-1)
    for at in _by_length(words, 2_000):
        coded = _coded([words[i] for i in at])
        if weights.ndim == 1:
            total = _sums(coded, weights)
        else:
            total = np.zeros((len(at), *weights.shape[1:]), np.float32)
            for weight, code in _triples(coded):
                total += weight * weights[code]
        size = norms(coded)
        out[at] = total / np.where(size > 0, size, 1).reshape(-1, *[1] * (weights.ndim - 1))
    return out


class Columns:
    """Columns of triple weights, of which only the rows with triples that occur are held; row 0 is that of all others."""

    ndim = 2

    def __init__(self, triples: list[dict[int, float]]) -> None:
        self.codes = np.array(sorted({c for t in triples for c in t}), np.int64)
        self.row = np.zeros(LETTERS**LENGTH, np.int32)
        self.row[self.codes] = np.arange(1, len(self.codes) + 1)
        self.rows = np.zeros((len(self.codes) + 1, len(triples)), np.float32)
        self.shape = (LETTERS**LENGTH, len(triples))
        for m, t in enumerate(triples):
            self.rows[self.row[[*t]], m] = [*t.values()]

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        return self.rows[self.row[code]]

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the columns, each by its weight, with a row for every triple."""
        out = np.zeros(LETTERS**LENGTH, np.float32)
        out[self.codes] = self.rows[1:] @ weights
        return out


def landmark_columns(words: list[str]) -> Columns:
    """The normalized triple weights of landmarks, a column each."""
    found = []
    for w in words:
        coded = _coded([w])
        triples: dict[int, float] = defaultdict(float)
        for weight, code in _triples(coded):
            if code[0]:
                triples[int(code[0])] += weight
        size = norms(coded)[0]
        found.append({c: x / size for c, x in triples.items()} if size > 0 else {})
    return Columns(found)


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias of a squared-hinge support vector machine, by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(x1.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        a, u = x1[inside], weight[inside]
        new = np.linalg.solve(ridge * keep + (a * u[:, None]).T @ a, (a * u[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one for each triple
    bias: float
    trust: np.ndarray  # weights of ``features``, and a constant

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word: of its worst window if it is long."""
        parts = [w.strip(_EDGE) for w in words]
        long = [i for i, p in enumerate(parts) if len(p) > WINDOW]
        owner = [*range(len(parts))]
        for i in long:
            parts[i], *more = _windows(parts[i])
            parts += more
            owner += [i] * len(more)
        got = project(parts, self.weights) + self.bias - np.float32(SPLIT) * np.array([" " in p for p in parts])
        out = got[: len(words)].copy()
        np.maximum.at(out, owner[len(words) :], got[len(words) :])
        return out

    def probability(self, facts: np.ndarray) -> np.ndarray:
        """From rows of ``features``."""
        return 1 / (1 + np.exp(-np.clip(facts @ self.trust[:-1] + self.trust[-1], -30, 30)))


NEVER = ToxicityModel(np.zeros(LETTERS**LENGTH, np.float32), -1.0, np.array([1.0, 0.0, 0.0, -1.0]))


def features(worst: np.ndarray, words: int) -> np.ndarray:
    """Of one document, from the margin of the worst window of each sentence and the number of windows: the worst margin, the mean of the
    WORST worst ones, and how many sentences hold an insult for every 30 windows, one at most."""
    if not len(worst):
        return np.array([-2.0, -2.0, 0.0])
    top = np.sort(np.clip(worst, -2, 2))[::-1][:WORST]
    hits = (1 / (1 + np.exp(-6 * np.clip(worst, -4, 4)))).sum()
    return np.array([top[0], (top.sum() - 2 * (WORST - len(top))) / WORST, min(1.0, 30 * hits / max(words, 30))])


def calibrated(facts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression; no feature counts against a document's being rejected."""
    x = np.hstack([facts, np.ones((len(facts), 1))])
    use, w = [0, 1, 2, 3], np.zeros(4)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * 0.5 + 0.5 / len(y)
    while True:
        w = np.zeros(4)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w[use], -30, 30)))
            keep = np.array([1e-4] * (len(use) - 1) + [1e-6])
            g = x[:, use].T @ (share * (p - y)) + keep * w[use]
            h = (x[:, use] * (share * (p * (1 - p) + 1e-7))[:, None]).T @ x[:, use] + np.diag(keep)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
            w[use] -= step
            if float(np.abs(step).max()) < 1e-6:
                break
        against = [i for i in use[:-1] if w[i] < 0]
        if not against:
            return w if len(use) > 1 else np.array([1e-3, 0.0, 0.0, w[3]])
        use = [i for i in use if i not in against]


def _varied(word: str, seed: int) -> list[str]:
    """The word with signs between its letters, and with a letter inserted."""
    draw = np.random.default_rng(seed)
    out = [c.join(word) for c in (".", "-")]
    at = int(draw.integers(1, max(2, len(word))))
    return [*out, word[:at] + chr(97 + int(draw.integers(26))) + word[at:], word[:at] + "*" + word[at:]]


def _pieces(word: str) -> list[str]:
    marked = f"^{word}$"
    return list({marked[i : i + n] for n in (4, 6) for i in range(max(1, len(marked) - n + 1))})


def _evidence(bags: list[Counter], toxic: list[int]) -> dict[str, float]:
    """For each window of rejected documents the evidence of its best piece: the log odds of its rates in both labels, less two deviations."""
    count = {0: Counter(), 1: Counter()}
    for bag, label in zip(bags, toxic):
        count[label].update(bag)
    pieces = {0: Counter(), 1: Counter()}
    for label in (0, 1):
        for w, n in count[label].items():
            for g in _pieces(w):
                pieces[label][g] += n
    size = {label: 1 + sum(count[label].values()) for label in (0, 1)}
    odds = {}
    for g, n in pieces[1].items():
        m = pieces[0][g]
        # Half an occurrence is added to both.
        odds[g] = math.log((n + 0.5) / size[1]) - math.log((m + 0.5) / size[0]) - 2 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
    return {w: max(odds[g] for g in _pieces(w)) for w in count[1]}


def _spread(words: list[str], most: int) -> list[str]:
    """Up to ``most`` of the words by farthest-first choice from the first one on; the kernel is approximated by hashed triples."""
    near, rows = None, np.zeros((len(words), 4096), np.float32)
    for at in _by_length(words):
        for weight, code in _triples(_coded([words[i] for i in at])):
            mixed = code.astype(np.uint32) * np.uint32(2654435761)
            rows[at, (mixed >> 16) & 4095] += np.where(code > 0, weight, 0) * np.where(mixed & 1, 1, -1)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    chosen = [0]
    while len(chosen) < min(most, len(words)):
        now = rows @ rows[chosen[-1]]
        near = now if near is None else np.maximum(near, now)
        near[chosen] = 2.0
        chosen.append(int(np.argmin(near)))
    return [words[i] for i in chosen]


def train(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fit on whole texts with labels."""
    cut = [[[sys.intern(p.lower()) for w in words_of(x) for p in _windows(w) if p] for x in sentences_of(t or "")] for t in texts]
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return NEVER
    # Every fourth document of either label is kept for calibration, where there are enough.
    place = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    aside = (place % 4 == 0) if min((y == 1).sum(), (y == 0).sum()) >= 40 else np.zeros(len(y), bool)
    bags = [Counter(w for x in doc for w in x) for doc, a in zip(cut, aside) if not a]
    if aside.any():  # the others' sentences are not needed any more
        cut = [doc if a else [] for doc, a in zip(cut, aside)]
    labels = [t for t, a in zip(toxic, aside) if not a]
    guess = _evidence(bags, labels)
    seen = Counter()
    for bag, label in zip(bags, labels):
        if not label:
            seen.update(bag.keys())
    # The best windows of each rejected document, as far as they have any evidence.
    witnesses = Counter()
    for bag, label in zip(bags, labels):
        if label:
            witnesses.update(sorted((w for w in bag if guess[w] > 0.5), key=lambda w: (-guess[w], w))[:WITNESSES])
    clean = [w for w, _ in seen.most_common(3000)]
    common = set(clean)
    rare = sorted(w for w in seen if w not in common)
    clean += [rare[i] for i in np.random.default_rng(3).permutation(len(rare))[:3000]]
    model = NEVER
    hard: list[str] = []
    words = sorted({w for bag in bags for w in bag})
    for turn in range(ROUNDS):
        ranked = [w for w, _ in sorted(witnesses.items(), key=lambda p: (-p[1] * max(0.1, guess[p[0]]), p[0]))][:1200]
        if not ranked or not clean:
            return model
        varied = [v for i, w in enumerate(ranked[:200]) for v in _varied(w, i)]
        positive, negative = ranked + varied, clean + hard
        marks = _spread(ranked[:600], LANDMARKS * 3 // 4)
        marks += [negative[i] for i in np.random.default_rng(5).permutation(len(negative))[: LANDMARKS - len(marks)]]
        columns = landmark_columns(marks)
        gram = project(marks, columns).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
        x = project(positive + negative, columns).astype(np.float64) @ root
        count = np.array([witnesses[w] for w in ranked], np.float64)
        share = np.concatenate([np.sqrt(count), np.full(len(varied), 0.5 * np.sqrt(count).sum() / max(1, len(varied)))])
        # A window counts the more the more clean documents have it.
        usual = np.power([1.0 + seen[w] for w in negative], 0.75)
        usual[len(clean) :] *= 3
        weight = np.concatenate([share / share.sum(), 5 * usual / usual.sum()])
        w = linear_machine(x, np.concatenate([np.ones(len(positive)), -np.ones(len(negative))]), weight * 100)
        model = ToxicityModel(columns.weighted(root @ w[:-1]), float(w[-1]), NEVER.trust)
        margin = dict(zip(words, model.margins(words).tolist()))
        if turn < ROUNDS - 1:
            witnesses = Counter()
            for bag, label in zip(bags, labels):
                if label:
                    witnesses.update(sorted((w for w in bag if margin[w] > -0.3 and guess[w] > 0.5), key=lambda w: (-margin[w], w))[:WITNESSES])
            hard = sorted({*hard, *sorted((w for w in seen if margin[w] > -0.5), key=lambda w: (-margin[w] * math.sqrt(seen[w]), w))[:1500]})
    chosen = [i for i in range(len(y)) if aside[i] or not aside.any()]
    new = sorted({w for i in chosen for x in cut[i] for w in x} - margin.keys())
    margin.update(zip(new, model.margins(new).tolist()))
    facts = np.array([features(np.array([max(map(margin.__getitem__, x)) for x in cut[i] if x]), sum(map(len, cut[i]))) for i in chosen])
    model.trust = calibrated(facts, y[chosen])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (4, 2)) -> ToxicityModel:
    """Fit on documents that ``labels`` marks 0 or 1 and whose crc32(id) mod ``held_out[0]`` is not ``held_out[1]``.

    MOST_LABELLED documents of each label take part, chosen by a hash of their id; of a text of more than FIT_CHARS
    characters the fit reads so many from a place that the hash chooses. Without documents of both labels every score is low.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(crc % held_out[0] != held_out[1])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = rows.select("doc_id").join(marked, "doc_id")
    chosen = []
    for label in (0, 1):
        chosen += known.filter(F.col("y") == label).orderBy(draw, "doc_id").limit(MOST_LABELLED).collect()
    if not chosen:
        return NEVER
    label_of = {r.doc_id: r.y for r in chosen}
    begin = F.pmod(draw, F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1).cast("int") + 1
    found = rows.filter(F.col("doc_id").isin([*label_of])).select("doc_id", F.substring("text", begin, F.lit(FIT_CHARS)).alias("text")).orderBy("doc_id", "text").limit(2 * len(chosen)).collect()
    return train([r.text for r in found], [label_of[r.doc_id] for r in found])


class _Words(dict):
    """Numbers of words, in the order in which they came."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _ends(word: str) -> bool:
    """Whether a sentence ends after the word, as ``sentences_of`` cuts."""
    return word[-1] in ".!?" and len(word) > 2 and word[-2] not in ".!?" and word[-3] not in ".!?"


def _single(word: str) -> bool:
    """Whether the word may be in a row of single characters, as _SPACED has them."""
    return len(word) == 1 or len(word) == 2 and not (word[1].isalnum() or word[1] == "_")


class _Scorer:
    """Scores texts by what ``sentences_of`` and ``words_of`` make of them, over the numbers of all words of a batch at once."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.words, self.pairs, self.beside = _Words(), np.empty(0, np.int64), np.empty(0)
        self.margin, self.size, self.ends, self.single = np.empty(0), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)

    def margins(self, words: list[str]) -> np.ndarray:
        """Words that differ in case or in signs at their ends are scored once."""
        plain = _Words()
        at = [plain[w.strip(_EDGE).lower()] for w in words]
        bare = [*plain]
        return np.concatenate([np.empty(0), *(self.model.margins(bare[i : i + 20_000]) for i in range(0, len(bare), 20_000))])[at] if at else np.empty(0)

    def _learn(self) -> None:
        new = [*islice(self.words, len(self.margin), None)]
        self.margin = np.concatenate([self.margin, self.margins(new)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
        self.ends = np.concatenate([self.ends, np.fromiter(map(_ends, new), bool, len(new))])
        self.single = np.concatenate([self.single, np.fromiter(map(_single, new), bool, len(new))])

    def _beside(self, codes: np.ndarray) -> np.ndarray:
        """Margins of pairs of neighbours, from the numbers of both in one."""
        codes, back = np.unique(codes, return_inverse=True)
        new = codes[~np.isin(codes, self.pairs, assume_unique=True)]
        if len(new):
            word = [*self.words]
            got = self.margins([word[c >> 32] + " " + word[c & 0xFFFFFFFF] for c in new.tolist()])
            self.pairs, order = np.unique(np.concatenate([self.pairs, new]), return_index=True)
            self.beside = np.concatenate([self.beside, got])[order]
        return self.beside[np.searchsorted(self.pairs, codes)][back]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) + len(self.pairs) > WORDS_HELD:
            self.forget()
        number, found = self.words.__getitem__, []
        for t in texts:
            words = t.split() if t else []
            found.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn()
        at, sizes = np.concatenate([np.empty(0, np.int64), *found]), np.array([*map(len, found)], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        last = self.ends[at]
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        begin = np.flatnonzero(np.concatenate([[True], last[:-1]])[: len(at)])
        sentence = np.cumsum(last) - last
        worst = np.maximum.reduceat(self.margin[at], begin) if len(at) else np.empty(0)
        bounds = np.searchsorted(doc[begin], np.arange(len(texts) + 1))
        short = self.size[at] <= NEAR
        near = np.flatnonzero(short[:-1] & short[1:] & ~last[:-1])
        if len(near):
            np.maximum.at(worst, sentence[near], self._beside((at[near] << 32) + at[near + 1]))
            sizes = sizes + np.bincount(doc[near], minlength=len(texts))
        single = self.single[at]
        for d in np.unique(doc[:-2][single[:-2] & single[1:-1] & single[2:] & (doc[:-2] == doc[2:])]).tolist():
            cut = [x for x in sentences_of(texts[d]) if x and not x.isspace()]
            rows = [(bounds[d] + i, "".join(m.group().split())) for i, x in enumerate(cut) for m in _SPACED.finditer(x)]
            np.maximum.at(worst, np.array([i for i, _ in rows], np.int64), self.margins([w for _, w in rows]))
            sizes[d] += len(rows)
        return self.model.probability(np.array([features(worst[a:b], n) for a, b, n in zip(bounds.tolist(), bounds[1:].tolist(), sizes.tolist())]).reshape(-1, 3))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(crc % held_out[0] == held_out[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, score, predicted``, by a model fitted on ``labels``.

    Every sentence of a whole text is scored; null, empty and white texts have the score of a text without any word. Repeated
    rows give a row each; null ids are scored, never trained on, and not held out; an id with several texts trains with each. An
    empty table gives no rows; other columns are not read.
    """
    return score(docs, fit(docs, labels, id_col, text_col, label_col, held_out), id_col, text_col, held_out)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under THRESHOLD."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in slices(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
