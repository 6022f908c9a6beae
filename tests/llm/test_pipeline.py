import random

import corpus_pipeline
from almanac.llm.registry import PACK_TOKENS
from tests.llm.test_classifiers import WORDS, labelled
from tests.llm.test_minhash import brute


def test_stages_in_turn(spark, tmp_path):
    """Each stage is run on what the one before it kept and held against labels or brute force."""
    rows, labels = labelled(7)
    draw = random.Random(9)
    base = [draw.choice(WORDS) + str(i) for i in range(300)]
    for k in range(30):  # near copies of a clean text, and exact ones
        w = list(base)
        for _ in range(k % 4):
            w[draw.randrange(len(w))] = "changed"
        rows.append((2000 + k, " ".join(w), "en", "a"))
    rows += [(3000, None, "en", "a"), (3001, "", "en", "a"), (None, "some words without an id here", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, toxic = {i: q for i, q, _ in labels}, {i: t for i, _, t in labels}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality classifier", "near duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = out.collect()
        ids = [r.doc_id for r in after]
        if name != "packing":
            assert out.columns == docs.columns and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "toxicity":
            assert sum(toxic.get(i, 0) for i in ids) <= 2 and sum(1 for i in ids if toxic.get(i) == 0) >= 0.98 * sum(1 for t in toxic.values() if not t)
        elif name == "quality classifier":
            assert sum(1 for i in ids if quality.get(i) == 0) <= 2
            clean = [r.doc_id for r in before if quality.get(r.doc_id) == 1]
            assert len(set(clean) & set(ids)) >= 0.98 * len(clean)
        elif name == "near duplicates":
            want = [i for i, _, c in brute([(r.doc_id, r.text) for r in before], 5) if i is None or i == c]
            assert sorted(ids, key=str) == sorted(want, key=str)
        else:
            assert sorted(ids, key=str) == sorted((r.doc_id for r in before), key=str)
            assert all(r.batch_docs * r.bucket_len <= PACK_TOKENS or r.batch_docs == 1 for r in after)
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
