"""Modified Kneser-Ney over unfolded characters, in tables that grow with the corpus.

A text is the characters of its words, each word followed by a blank. The history of a character
is the ORDER - 1 characters before it, which reach over the blank into the word before. Grams are
strings in tables by model, whose number nothing bounds; workers hold them as sorted arrays of hashes.
Texts are dealt into two folds by their hash, and a fold is scored by the counts of the other one only: a
text, and every copy of it, has no part in its own score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.llm.common import new_path, slices, utf8

ORDER = 4
PAD = " " * (ORDER - 1)
#: Characters of text in one part of the documents: a part asks for its grams once.
PART_CHARS = 8_000_000
#: Distinct words that a worker holds for all languages together, and rows of joints before they are added up.
WORDS_HELD, JOINTS_HELD = 250_000, 1_000_000
POOLED = ""
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fold_of(text: str) -> int:
    """0 or 1; copies of a text have the same."""
    return zlib.crc32(utf8(text)) & 1


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialize``, in files that are smaller."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """``part, packed``: the rows of ``doc_id, lang, text`` packed by some PART_CHARS characters, written to the shared folder."""

    def run(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "packed"])

        for batch in slices(batches, 200):
            if not batch.num_rows:
                continue
            # A slice is copied, so that its neighbours' text is neither held nor counted.
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(i)]).take(pa.array(range(batch.num_rows))) for i in range(3)], names=["doc_id", "lang", "text"]))
            size += held[-1].nbytes
            if size >= PART_CHARS:
                yield packed()
                made, held, size = made + 1, [], 0
        if held:
            yield packed()

    return written(rows.select("doc_id", "lang", "text").mapInArrow(run, "part long, packed binary"), "parts")


def unpacked(packed: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(pa.py_buffer(packed)))


class Words(dict):
    """Numbers of the distinct words of one language, with what their neighbours see of them.

    A joint is what a word's first ORDER - 1 characters see of the word before: the tail of one word and the head
    of the next. Number 0 is the empty word before the first.
    """

    def __init__(self) -> None:
        self.inner, self.tails, self.heads = [], {}, {}
        self.tail, self.head, self.lettered = [], [], []
        self[b""]

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "surrogatepass")
        self.inner.append(text + " ")
        self.tail.append(self.tails.setdefault((PAD + text + " ")[-len(PAD) :] if text else PAD, len(self.tails)))
        self.head.append(self.heads.setdefault((text + " ")[: len(PAD)], len(self.heads)))
        self.lettered.append(any(map(str.isalnum, text)))
        n = self[word] = len(self.inner) - 1
        return n

    def numbered(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the texts in a row its text, its number and its joint."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter((self[w] for words in texts for w in words), np.int64, int(sizes.sum()))
        before = np.zeros(len(at), np.int64)
        before[1:] = at[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        return np.repeat(np.arange(len(texts)), sizes), at, (np.array(self.tail)[before] << 32) + np.array(self.head)[at]

    def joints(self, codes: np.ndarray) -> list[str]:
        tails, heads = list(self.tails), list(self.heads)
        return [tails[c >> 32] + heads[c & 0xFFFFFFFF] for c in codes.tolist()]


def hashes(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Hash, string number and position of every gram of the strings, and the strings in a row; strings shorter than a gram have none."""
    line = "".join(strings)
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    points ^= points >> np.uint64(31)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    count = np.maximum(sizes - ORDER + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(sizes) - sizes, count)
    value = np.zeros(len(start), np.uint64)
    for j in range(ORDER):
        value = (value * _BASE) + points[start + j]
        value ^= value >> np.uint64(29)
    return value, owner, start, line


class Counts:
    """Counts of the grams of one language in both folds."""

    def __init__(self) -> None:
        self.grams, self.n = np.empty(0, f"U{ORDER}"), np.zeros((2, 0), np.int64)
        self._clear()

    def _clear(self) -> None:
        self.words, self.times, self.codes, self.joined = Words(), np.zeros((2, 0), np.int64), np.empty(0, np.int64), np.zeros((2, 0), np.int64)

    def add(self, texts: list[list[bytes]], folds: np.ndarray) -> None:
        owner, at, joint = self.words.numbered(texts)
        fold = folds[owner]
        grown = np.stack([np.bincount(at[fold == f], minlength=len(self.words)) for f in (0, 1)])
        grown[:, : self.times.shape[1]] += self.times
        self.times = grown
        codes, back = np.unique(joint, return_inverse=True)
        self.codes = np.concatenate([self.codes, codes])
        self.joined = np.hstack([self.joined, np.stack([np.bincount(back[fold == f], minlength=len(codes)) for f in (0, 1)])])
        if len(self.codes) > JOINTS_HELD:
            self.codes, self.joined = _summed(self.codes, self.joined)

    def fold(self) -> None:
        """Turn the words held into grams, and forget them."""
        if not len(self.codes):
            return
        codes, joined = _summed(self.codes, self.joined)
        strings = self.words.inner + self.words.joints(codes)
        value, owner, start, line = hashes(strings)
        distinct, first, back = np.unique(value, return_index=True, return_inverse=True)
        times = np.hstack([self.times, joined])[:, owner]
        n = np.stack([np.bincount(back, t, len(distinct)) for t in times]).astype(np.int64)
        grams = np.array([line[s : s + ORDER] for s in start[first].tolist()], f"U{ORDER}")
        some = n.any(axis=0)  # the empty word's own grams are none
        self.grams, self.n = _summed(np.concatenate([self.grams, grams[some]]), np.hstack([self.n, n[:, some]]))
        self._clear()

    def batch(self, *before: tuple[str, object, pa.DataType]) -> pa.RecordBatch:
        self.fold()
        own = [("gram", self.grams.tolist(), pa.string()), ("n0", self.n[0], pa.int64()), ("n1", self.n[1], pa.int64())]
        return pa.RecordBatch.from_arrays([*(pa.array([v] * len(self.grams), kind) for _, v, kind in before), *(pa.array(v, kind) for _, v, kind in own)], names=[x[0] for x in (*before, *own)])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(back, x, len(distinct)) for x in n]).astype(np.int64)


def by_language(langs: list[str]) -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        groups.setdefault(lang, []).append(i)
    return groups


def _gathered(batches) -> dict[str, Counts]:
    """The counts of each language over batches with ``lang, text``; no more than WORDS_HELD words are held, give or take a batch."""
    held: dict[str, Counts] = {}
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lang, rows in by_language(batch.column("lang").to_pylist()).items():
            held.setdefault(lang, Counts()).add([utf8(texts[i]).split() for i in rows], np.array([fold_of(texts[i]) for i in rows]))
        while sum(len(c.words) for c in held.values()) > WORDS_HELD + len(held):
            max(held.values(), key=lambda c: len(c.words)).fold()
    return held


def counted(rows: DataFrame) -> DataFrame:
    """``lang, gram, n0, n1``: the grams of ``lang, text``, counted in both folds; each task adds up its own before anything is sent."""

    def run(batches):
        for lang, counts in _gathered(slices(batches)).items():
            yield counts.batch(("lang", lang, pa.string()))

    made = rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n0 long, n1 long")
    return made.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def asked(parts: DataFrame) -> DataFrame:
    """``part, lang, gram`` of each part."""

    def run(batches):
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                for lang, counts in _gathered(unpacked(packed.as_py())).items():
                    yield counts.batch(("part", part, pa.int64()), ("lang", lang, pa.string())).select(["part", "lang", "gram"])

    return parts.mapInArrow(run, "part long, lang string, gram string")


def _discounts(level: DataFrame) -> DataFrame:
    """For each model and fold the discounts of counts 1, 2 and 3 or more; fixed ones where the counts of counts don't give them."""
    seen = level.groupBy("model").agg(F.count("*").alias("size"), *[F.sum((F.col(f"c{f}") == i).cast("double")).alias(f"n{f}{i}") for f in (0, 1) for i in range(1, 5)])
    made = {}
    for f in (0, 1):
        n = [F.col(f"n{f}{i}") for i in range(1, 5)]
        enough = (n[0] > 0) & (n[1] > 0) & (n[2] > 0)
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        for i, (d, plain) in enumerate(zip(raw, (0.5, 0.75, 0.9)), 1):
            made[f"d{f}{i}"] = F.when(enough, F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(plain))
    return seen.select("model", "size", *[c.alias(k) for k, c in made.items()])


def _taken(f: int) -> Column:
    c = F.col(f"c{f}")
    return F.when(c >= 3, F.col(f"d{f}3")).when(c == 2, F.col(f"d{f}2")).when(c == 1, F.col(f"d{f}1")).otherwise(F.lit(0.0))


def scored_grams(counts: DataFrame) -> DataFrame:
    """``model, gram, p0, p1``: the probability of the last character of each gram of ORDER, for texts of fold 0 (by the counts of fold 1) and of fold 1.

    Models are ``=`` and a language, and POOLED for all. Interpolated; below ORDER the distinct characters before a gram count.
    """
    own = counts.groupBy(F.concat(F.lit("="), "lang").alias("model"), "gram").agg(F.sum("n1").alias("c0"), F.sum("n0").alias("c1"))
    pooled = own.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).select(F.lit(POOLED).alias("model"), "gram", "c0", "c1")
    levels = {ORDER: written(own.unionByName(pooled), "grams")}
    for k in range(ORDER - 1, 0, -1):
        seen = [F.sum((F.col(f"c{f}") > 0).cast("long")).alias(f"c{f}") for f in (0, 1)]
        levels[k] = written(levels[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(*seen), "grams")
    below = None
    for k in range(1, ORDER + 1):
        near = Window.partitionBy("model", F.substring("gram", 1, k - 1))
        sums = {f"t{f}": F.sum(f"c{f}").over(near) for f in (0, 1)}
        for f in (0, 1):
            c = F.col(f"c{f}")
            sums |= {f"m{f}{i}": F.sum((c >= 3 if i == 3 else c == i).cast("int")).over(near) for i in (1, 2, 3)}
        t = levels[k].withColumns(sums).join(_discounts(levels[k]), "model")
        alone = {f"a{f}": (F.when(F.col(f"t{f}") > 0, (F.col(f"c{f}") - _taken(f)) / F.col(f"t{f}")).otherwise(F.lit(0.0))).cast("float") for f in (0, 1)}
        back = {f"g{f}": (F.when(F.col(f"t{f}") > 0, sum(F.col(f"d{f}{i}") * F.col(f"m{f}{i}") for i in (1, 2, 3)) / F.col(f"t{f}")).otherwise(F.lit(1.0))).cast("float") for f in (0, 1)}
        t = t.select("model", "gram", "size", F.substring("gram", 2, k - 1).alias("rest"), *[c.alias(x) for x, c in (alone | back).items()])
        if below is None:
            t = t.withColumns({f"b{f}": 1.0 / (F.col("size") + 1) for f in (0, 1)})
        else:
            t = t.drop("size").join(below.select("model", F.col("gram").alias("rest"), F.col("p0").alias("b0"), F.col("p1").alias("b1")), ["model", "rest"])
        p = [(F.col(f"a{f}") + F.col(f"g{f}") * F.col(f"b{f}")).cast("float").alias(f"p{f}") for f in (0, 1)]
        t = t.select("model", "gram", *p)
        below = written(t, "scores")
    return below


def logs_of(grams: DataFrame) -> DataFrame:
    """``lang, gram, own0, own1, all0, all1``: log probabilities by the language's model and by that of all languages."""
    logs = [F.log(f"p{f}").cast("float") for f in (0, 1)]
    own = grams.filter(F.col("model") != POOLED).select(F.substring("model", 2, 1 << 30).alias("lang"), "gram", logs[0].alias("own0"), logs[1].alias("own1"))
    pooled = grams.filter(F.col("model") == POOLED).select("gram", logs[0].alias("all0"), logs[1].alias("all1"))
    return own.join(pooled, "gram").select("lang", "gram", *LOGS)


LOGS = ("own0", "own1", "all0", "all1")


class Arrays:
    """The grams of one language: sorted hashes, and their four log probabilities."""

    def __init__(self, grams: list[str], logs: np.ndarray) -> None:
        value = hashes(grams)[0]
        order = np.argsort(value)
        self.value, self.logs = value[order], logs[:, order]

    def sums(self, strings: list[str]) -> np.ndarray:
        """The four sums over the grams of each string. Every gram of the corpus is here."""
        value, owner, _, _ = hashes(strings)
        at = np.searchsorted(self.value, value)
        return np.stack([np.bincount(owner, x[at], len(strings)) for x in self.logs])


def models_of(table: pa.Table) -> dict[str, Arrays]:
    """The arrays of each language from the columns of ``logs_of``."""
    lang = table["lang"].combine_chunks().dictionary_encode()
    codes, grams = lang.indices.to_numpy(zero_copy_only=False), table["gram"]
    logs = np.stack([table[c].to_numpy() for c in LOGS])
    out = {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        at = np.flatnonzero(codes == i)
        out[name] = Arrays(grams.take(pa.array(at)).to_pylist(), logs[:, at])
    return out


class Scorer:
    """Scores the texts of one language; the sums of words are remembered."""

    def __init__(self, arrays: Arrays) -> None:
        self.arrays = arrays
        self.forget()

    def forget(self) -> None:
        self.words, self.known = Words(), np.zeros((4, 0))

    def __call__(self, texts: list[list[bytes]], folds: np.ndarray, foreign: float) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each text and the number of its words with a letter or digit.

        A word's probability is that of its language's model, or with probability ``foreign`` that of all languages.
        """
        owner, at, joint = self.words.numbered(texts)
        have = self.known.shape[1]
        if len(self.words) > have:
            fresh = self.words.inner[have:]
            if not have:
                fresh = ["", *fresh[1:]]  # the empty word before the first is not in a text
            self.known = np.hstack([self.known, self.arrays.sums(fresh)])
        codes, back = np.unique(joint, return_inverse=True)
        joined = self.arrays.sums(self.words.joints(codes)) if len(codes) else np.zeros((4, 0))
        first = folds[owner] == 0
        own, pooled = (np.where(first, self.known[m, at] + joined[m, back], self.known[m + 1, at] + joined[m + 1, back]) for m in (0, 2))
        total = np.logaddexp(np.log(1 - foreign) + own, np.log(foreign) + pooled)
        return np.bincount(owner, total, len(texts)), np.bincount(owner, np.array(self.words.lettered)[at], len(texts)).astype(np.int64)


class Scorers(dict):
    """A scorer for each language; one whose texts have no word has no model and needs none."""

    def __init__(self, models: dict[str, Arrays]) -> None:
        super().__init__({k: Scorer(v) for k, v in models.items()})

    def bound(self) -> None:
        """Forget the most words until no more than WORDS_HELD are held for all languages together."""
        while sum(len(s.words) for s in self.values()) > WORDS_HELD + len(self):
            max(self.values(), key=lambda s: len(s.words)).forget()

    def __missing__(self, lang: str) -> Scorer:
        return Scorer(Arrays([], np.zeros((4, 0))))
