"""BPE by a tokenization automaton.

The arcs of the automaton are tokens, and it accepts the one tokenization that the
merges give each word. It starts as one state with a loop for every base symbol. Each
merge (a, b) is then worked in as a gadget: wherever an a-arc leads to a state with a
b-arc, an arc ab to the b-arc's target is added, and the a-arc is led to a copy of its target
that lacks the b-arc. All arcs with one label have one target, so a state is named by
the token read last, and a state differs from the one it was copied from by the arcs cut
since. The tables hold exactly that: birth rank, halves, and cut arcs; ``follows`` reads a transition
off them. Written out, the arcs would be the square of the vocabulary.

Encoding walks a pre-split word from arc to arc; a prefix of a word has one
tokenization only, so a position from which the walk fails need not be tried again.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import slices

#: Entries of the word and transition caches of one worker.
CACHE_ENTRIES = 600_000
_WHITE = "\t-\r \x85\xa0  -     　"
_FINAL = 256


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


class Automaton:
    """Compiled from the merges of a tokenizer file with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        byte_of = {s: b for b, s in byte_symbols().items()}
        self.labels = {i: t for t, i in vocab.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        made, unreached = set(), set()
        for rank, (a, b) in enumerate(merges):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if new in made:
                raise ValueError(f"token {new} is made by two merges")
            made.add(new)
            # Where no a-arc leads to a b-arc the gadget adds nothing: earlier merges always come between.
            if left in unreached or right in unreached or not self._arc(left, right, rank):
                unreached.add(new)
                continue
            self.halves[new], self.born[new], self.cut[left, right] = (left, right), rank, rank
        # Spelling of each token: a character for each byte, another for the byte at a word's end.
        self.token: dict[str, int] = {}
        for label, i in vocab.items():
            body, final = (label[: -len(end)], True) if end and label.endswith(end) and len(label) > len(end) else (label, False)
            if body and i not in unreached and all(c in byte_of for c in body):
                spelled = [byte_of[c] for c in body]
                spelled[-1] += _FINAL * final
                self.token["".join(map(chr, spelled))] = i
        self.longest = max(map(len, self.token), default=1)
        self._known: dict[tuple[int, int], bool] = {}

    def _arc(self, u: int, v: int, before: float) -> bool:
        """Whether the state after ``u`` has the arc ``v`` once the merges ranked below ``before`` are worked in."""
        while True:
            if self.cut.get((u, v), before) < before:
                return False
            at_u, at_v = self.born.get(u, -1), self.born.get(v, -1)
            if at_u < 0 and at_v < 0:
                return True
            if at_u == at_v:
                u, v, before = self.halves[u][1], self.halves[v][0], at_u
            elif at_u > at_v:  # copied from the state after its right half when it was made
                u, before = self.halves[u][1], at_u
            else:  # added where there was an arc of its left half, once that merge's cut was made
                v, before = self.halves[v][0], at_v + 1

    def follows(self, u: int, v: int) -> bool:
        known = self._known.get((u, v))
        if known is None:
            if len(self._known) >= CACHE_ENTRIES:
                self._known.clear()
            known = self._known[u, v] = self._arc(u, v, float("inf"))
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        spelled = word[:-1].decode("latin-1") + chr(word[-1] + _FINAL)
        n, token, follows, longest = len(spelled), self.token, self.follows, self.longest
        path: list[int] = []
        ends = [0]
        tries = [min(longest, n)]  # longest arc to try next from each position on the path
        dead = set()
        while ends[-1] < n:
            at, size, last = ends[-1], tries[-1], path[-1] if path else None
            while size:
                if at + size not in dead:
                    t = token.get(spelled[at : at + size])
                    if t is not None and (last is None or follows(last, t)):
                        break
                size -= 1
            if size:
                tries[-1] = size - 1
                path.append(t)
                ends.append(at + size)
                tries.append(min(longest, n - at - size))
            else:
                if not path:
                    raise ValueError("no path: a byte has no base symbol")
                dead.add(at)
                path.pop()
                ends.pop()
                tries.pop()
        return path


class Tokenizer:
    """Normalization, splitting and added tokens around the automaton, for files of the form of word_bpe_49k.json."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        kinds = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or spec["decoder"] or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError("a tokenizer of another form")
        pair = lambda m: tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
        self.automaton = Automaton(model["vocab"], [pair(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.labels = dict(self.automaton.labels)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t for t, i in self.added.items()}
        self._added = regex.compile("(" + "|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern.replace(r"^\s", "^" + _WHITE))
        self._white = regex.compile(f"[{_WHITE}]+")
        self._words: dict[str, tuple[str, str]] = {}
        self._chunks: dict[str, tuple[str, str]] = {}

    def _word(self, word: str) -> tuple[str, str]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= CACHE_ENTRIES:
                self._words.clear()
            ids = self.automaton.encode_word(word.encode("utf-8"))
            found = self._words[word] = (" ".join(map(str, ids)), " ".join([self.labels[i] for i in ids]))
        return found

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and labels of what stands between white space; neither normalization nor splitting reaches across it."""
        plain = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
        if plain.isalpha():  # letters alone: one word
            return self._word(plain)
        parts = [self._word(w) for w in ((plain[:-1], plain[-1]) if plain[-1] in ".," and plain[:-1].isalpha() else self._split.findall(plain))]
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def encode_joined(self, text: str) -> tuple[str, str]:
        """Decimal ids and labels of a text, each joined by one space."""
        pieces = self._added.split(text) if self._added is not None and "<" in text else (text,)
        ids, labels, chunks = [], [], self._chunks
        for k, piece in enumerate(pieces):
            if k % 2:
                ids.append(str(self.added[piece]))
                labels.append(piece)
                continue
            for w in self._white.split(piece):
                if not w:
                    continue
                found = chunks.get(w)
                if found is None:
                    if len(chunks) >= CACHE_ENTRIES:
                        chunks.clear()
                    found = chunks[w] = self._chunk(w)
                if found[0]:
                    ids.append(found[0])
                    labels.append(found[1])
        return " ".join(ids), " ".join(labels)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels in order; the file names no decoder, so they are joined by spaces."""
        return " ".join([self.labels[i] for i in ids])


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once in each worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids``.

    ``path`` names the tokenizer file on every worker. Whole texts are encoded; a null text is
    encoded as an empty one and has no tokens. Strings of special tokens in a text become those tokens. Null
    ids and repeated rows give a row each; an empty table gives none; other columns
    are not read, so their names may clash. Ids keep the type of ``id_col``.
    """

    def run(batches):
        tokenizer = load(path)
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                ids, labels = tokenizer.encode_joined(text) if text else ("", "")
                out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(labels.encode("utf-8", "surrogatepass")).hexdigest(), [int(i) for i in ids.split()] if with_ids else None))
            cols = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array([x[3] for x in out], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
