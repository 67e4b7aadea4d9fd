"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, packing, quality, recompression, simhash, suffixes, tokenfile, topk, toxicity
from .common import fresh_path, read_documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(read_documents(spark, sf_dir), window=200).drop("kept", "removed")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), WORDS, capacity=2048, end_id=0)


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeated_words(read_documents(spark, sf_dir), window=20).drop("kept", "removed")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256.0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir), shingle=4, reach=4)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokenfile.write(read_documents(spark, sf_dir), path, WORDS, end_id=1)
    return tokenfile.digests(spark, path)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read_documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_best_fit_packing, op4_recompression, op5_quality, op6_exact_top_k, op7_simhash, op8_token_files, op9_byte_bpe, op10_fingerprints)}


#: DuckDB SQL of the operators that it can express: whole numbers up to 2^53 are exact in its inner product.
TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""


#: Every window as text; those that are not the first of their like go.
WORDS_SQL = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE r > 1),
u AS (SELECT doc_id, unnest(range(len(ws))) AS j, unnest(ws) AS x FROM w),
s AS (SELECT u.doc_id, count(gone.j) AS n_removed, string_agg(x, ' ' ORDER BY u.j) FILTER (WHERE gone.j IS NULL) AS kept FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.j = gone.j GROUP BY 1)
SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON w.doc_id = s.doc_id"""
#: Bytes as pairs of hexadecimal digits; starts of windows that come twice make spans where they overlap.
BYTES_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, sha256(substring(h, 2 * i + 1, 400)) AS win FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM b)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM k) WHERE n > 1),
m AS (SELECT *, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM m GROUP BY doc_id, span),
p AS (SELECT s.doc_id, a, z, substring(h, 2 * coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS piece FROM s JOIN b ON s.doc_id = b.doc_id),
g AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(piece, '' ORDER BY a) AS head FROM p GROUP BY 1)
SELECT b.doc_id AS doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN g ON b.doc_id = g.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": BYTES_SQL, "op4_recompression": WORDS_SQL, "op6_exact_top_k": TOP_K}
