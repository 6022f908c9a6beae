import hashlib
import random

import pytest

from almanac.llm import bpe
from tests.llm.cases import DOCS, docs

public = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return library.Tokenizer.from_file(PATH), bpe.load(PATH)


def same(both, text):
    ref, own = both
    ids = ref.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, text[:80]
    assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False) == own.encode_joined(text)[1]


def test_like_the_library(both):
    draw = random.Random(4)
    letters = "aaabcdeéèßñÀÉİΣσςΑ中文日本🎉é \t\n\x0b\x1c\x85\xa0  　'’stvmld0123½²Ⅷ!@#$%^&*()_+-=<>|ﬁ​­"
    for _ in range(1500):
        same(both, "".join(draw.choice(letters) for _ in range(draw.randint(0, 30))))
        same(both, "".join(draw.choice("aabeeehnotthing") for _ in range(draw.randint(0, 30))))
    for text in ("", " ", "a" * 300, "haha" * 60, "<|endoftext|>hi <|startoftext|>x<|endoftext|", "it's we'll CAN'T", *[d[1] for d in DOCS if d[1]]):
        same(both, text)


def test_transitions_agree_with_merging():
    """On a small alphabet: the automaton accepts exactly what merging gives."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("aa", "a"), ("ab", "ab"), ("aa", "aa"), ("c", "a"), ("ba", "ba")]
    vocab = {s: i for i, s in enumerate(["a", "b", "c", *[x + y for x, y in merges]])}
    auto = bpe.Automaton(vocab | {t + "</w>": 1000 + i for t, i in list(vocab.items())[:3]}, merges, "</w>")
    rank = {m: i for i, m in enumerate(merges)}

    def merged(word):
        parts = list(word[:-1]) + [word[-1] + "</w>"]
        while True:
            spots = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not spots:
                return parts
            _, i = min(spots)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    labels = auto.labels
    draw = random.Random(1)
    for _ in range(3000):
        word = "".join(draw.choice("aaabbc") for _ in range(draw.randint(1, 14)))
        assert [labels[i] for i in auto.encode_word(word.encode())] == merged(word), word


def test_documents(spark, both):
    out = bpe.encode_documents(docs(spark), PATH, with_ids=True).collect()
    assert len(out) == len(DOCS)
    for r in out:
        if r.doc_id in (4, 5, 6):
            assert (r.n_tokens, r.ids_sha256, r.ids) == (0, hashlib.sha256(b"").hexdigest(), [])
    ref = both[0]
    for i, text, *_ in DOCS:
        ids = ref.encode(text or "", add_special_tokens=False).ids
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert any(r.doc_id == i and r.ids_sha256 == want and r.n_tokens == len(ids) == len(r.ids) for r in out)
    assert bpe.encode_documents(docs(spark, []), PATH).count() == 0
