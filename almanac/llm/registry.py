"""The corpus operators as queries over the tables of ``sf_dir``, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import bpe, html_text, minhash, packing, quality_model, quality_rules, sharding, topk, toxicity, warc
from almanac.llm.common import table

SHARD_BYTES = 1 << 20
PACK_BUCKETS, PACK_TOKENS = 16, 1 << 16
BPE_FILE = "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=(5, 0))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES).drop("copy")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=(4, 2))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACK_BUCKETS, PACK_TOKENS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"]
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*names)


OP2_SQL = f"""
WITH alike AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, count(*) AS n FROM documents GROUP BY 1, 2
), sized AS (
  SELECT doc_id, n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || n_bytes || ':' || c), 1, 13))::BIGINT AS h
  FROM (SELECT doc_id, n_bytes, unnest(generate_series(0, n - 1)) AS c FROM alike)
), levels AS (
  SELECT doc_id, n_bytes, d::INT AS depth, h >> (52 - d)::INT AS prefix FROM sized CROSS JOIN generate_series(0, 52) AS g(d)
), buckets AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM levels GROUP BY 1, 2
  HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1
), leaf AS (
  SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs,
         row_number() OVER (PARTITION BY doc_id, n_bytes ORDER BY depth) AS rn
  FROM levels JOIN buckets USING (depth, prefix)
)
SELECT doc_id, n_bytes, depth,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard, shard_bytes, shard_docs
FROM leaf WHERE rn = 1
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""

OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), sized AS (
  SELECT doc_id, len(sh) AS n, sh FROM s
), g AS (
  SELECT doc_id, n, unnest(sh) AS x FROM sized
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, 3, 4
), links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT b, a FROM shared WHERE 100 * c >= 80 * (na + nb - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), comp AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN comp USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_sharding, op3_toxicity, op4_html, op5_topk, op6_bpe, op7_packing, op8_warc, op9_minhash, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op5_topk": OP5_SQL, "op8_warc": OP8_SQL, "op9_minhash": OP9_SQL}
