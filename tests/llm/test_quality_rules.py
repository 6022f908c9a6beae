import math
import random
import re
from collections import Counter

import numpy as np

from almanac.llm import charmodel, quality_rules
from tests.llm.cases import DOCS, docs


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    again = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)})
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, again


def test_counts(spark):
    draw = random.Random(1)
    rows = DOCS + [(100 + i, " ".join(draw.choice(["a", "b", "#c", "d|\n", "e\t"]) for _ in range(draw.randint(0, 60))), "en", "a") for i in range(60)] + [(300, "a b c\n\n a\na b c\n \n \na b c", "en", "a")]
    out = quality_rules.quality_rules(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=str)
    assert got == sorted(((i, *brute_counts(t)) for i, t, *_ in rows), key=str)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and (r.log_perplexity is None) == (r.n_words == 0)
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def test_strange_text_is_rejected_and_plain_text_kept(spark):
    draw = random.Random(5)
    syllables = ["the", "an", "ing", "er", "re", "on", "st", "ha"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(120)), "en", "a") for i in range(300)] + [(1000 + i, " ".join("".join(draw.choice("QXZJVKW#%") for _ in range(8)) for _ in range(120)), "en", "a") for i in range(6)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert not any(kept[1000 + i] for i in range(6)) and sum(kept[i] for i in range(300)) >= 297


def test_word_order_and_every_script_count(spark):
    draw = random.Random(9)
    chain = {c: draw.sample(range(40), 3) for c in range(40)}
    scripts = {"en": lambda c: f"{chr(97 + c % 26)}{c}w{chr(97 + c % 7)}", "ru": lambda c: chr(0x430 + c % 32) + chr(0x430 + c * 7 % 32) + chr(0x451), "zh": lambda c: chr(0x4E00 + 12 * c) + chr(0x5E00 + 12 * c)}
    rows, pairs = [], []
    for lang, name in scripts.items():
        for i in range(120):
            at, words = draw.randrange(40), []
            for _ in range(150):
                words.append(name(at))
                at = draw.choice(chain[at])
            rows.append((len(rows), " ".join(words), lang, "a"))
            if i < 5:
                draw.shuffle(words)
                rows.append((len(rows), " ".join(words), lang, "a"))
                pairs.append((len(rows) - 2, len(rows) - 1))
    got = {r.doc_id: r.log_perplexity for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(got[shuffled] > fluent + math.log(1.1) for fluent, shuffled in ((got[a], b) for a, b in pairs))


def test_grams_equal_plain_counts_and_probabilities_sum_to_one(spark):
    rows = quality_rules._named(docs(spark), ["en"], "doc_id", "lang", "text")
    counts = charmodel.counted(rows).cache()
    want = Counter()
    for _, text, lang, _ in DOCS:
        before, fold = "", charmodel.fold_of(text or "")
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            line = ((charmodel.PAD + before + " ") if before else charmodel.PAD)[-len(charmodel.PAD) :] + word + " "
            want.update(("en" if lang == "en" else "other", line[i : i + charmodel.ORDER], fold) for i in range(len(line) - charmodel.ORDER + 1))
            before = word
    got = Counter()
    for r in counts.collect():
        got.update({(r.lang, r.gram, 0): r.n0, (r.lang, r.gram, 1): r.n1})
    assert +got == want
    sums = {}
    for r in charmodel.scored_grams(counts).collect():
        assert 0 < r.p0 <= 1 and 0 < r.p1 <= 1
        for f, p in enumerate((r.p0, r.p1)):
            sums[r.model, r.gram[:-1], f] = sums.get((r.model, r.gram[:-1], f), 0) + p
    assert max(sums.values()) < 1 + 1e-4


def test_every_language_has_its_own_band(spark):
    rows = [(i, f"w{i % 7} a b c d e f g h i j k l m n o p", f"l{i % 40:02}", "a") for i in range(200)]
    out = quality_rules.quality_rules(docs(spark, rows))
    assert {r.lang for r in out.select("lang").distinct().collect()} == {f"l{i:02}" for i in range(40)}


def test_signs_between_words_are_rejected_in_every_language(spark):
    """Menus and words hung with signs are a tenth of each language, as frequent as to be part of its model."""
    draw = random.Random(3)
    rows, junk = [], set()
    for lang, syllables in (("en", "the an ing er re on st ha".split()), ("de", "ung ein ä ßer lich ver keit".split())):
        usual = [draw.choice(syllables) + draw.choice(syllables) for _ in range(12)]
        rare = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(2, 4)))  # noqa: B023, E731
        for i in range(300):
            words = [draw.choice(usual) if draw.random() < 0.4 else rare() for _ in range(150)]
            if i % 20 == 0:
                words = [w + draw.choice(["%%%", "###", "$$$"]) for w in words]
            elif i % 20 == 10:
                words = [x for w in words for x in (rare(), "|")]
            if i % 10 == 0:
                junk.add(len(rows))
            rows.append((len(rows), " ".join(words), lang, "a"))
    out = quality_rules.quality_rules(docs(spark, rows)).collect()
    assert sum(r.kept for r in out if r.doc_id in junk) <= 0.05 * len(junk)
    assert sum(not r.kept for r in out if r.doc_id not in junk) <= 0.01 * len(rows)


def test_parts_give_what_whole_models_give(spark, monkeypatch):
    key = lambda rows: sorted((tuple(None if x is None else round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    whole = key(quality_rules.quality_rules(docs(spark)).collect())
    monkeypatch.setattr(quality_rules, "MODEL_ROWS", 0)
    monkeypatch.setattr(charmodel, "WORDS_HELD", 50)
    monkeypatch.setattr(charmodel, "PART_CHARS", 500)
    assert key(quality_rules.quality_rules(docs(spark)).collect()) == whole
