"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents. Rows that share a doc_id share a decision; rows with a null doc_id are kept by the filters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquill.llm import minhash, packing, quality, recompression, toxicity
from loomquill.llm.common import BROADCAST_ROWS, read_documents, written

#: Words that a worker of the last stage remembers: executors come to it with the memory that four stages left in use.
MEMO = 120_000

#: The stages are models, fingerprints and a tokenizer: no SQL gives their rows; tests/llm checks near duplicates by brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs less the ids rejected: by broadcast where they are few, by a shuffle otherwise."""
    ids = written(rejected.select(F.col("doc_id").alias("_gone")).dropna().distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, docs["doc_id"] == ids["_gone"], "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality.classify(docs, _labels(spark, sf_dir), "source", "lang").where("predicted = 0"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, toxicity.toxicity(docs, _labels(spark, sf_dir)).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one of smallest id, and every row without an id.

    Candidates by SimHash's segment counts and by MinHash, checked on whole shingle sets (`minhash`). Rows are told apart by
    id and text, so different texts that share an id are decided each.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    rows = docs.where("doc_id is not null").select(key.alias("r")).groupBy("r").count()
    rows = written(rows.join(minhash.near_groups(docs), F.col("r.key") == F.col("key")).select("r", "count", "component"), "near-groups")
    firsts = rows.groupBy("component").agg(F.min("r").alias("first"))
    gone = written(rows.join(firsts, "component").where("r <> first").select(F.col("r").alias("_gone")), "rejected")
    kept = docs.withColumn("_r", key)
    kept = kept.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("_r") == F.col("_gone"), "left_anti")
    if not rows.where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["_r"]).union(kept.where("doc_id is null"))
    return kept.drop("_r")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document alone."""
    return recompression.without_repeats(docs, window=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0, memo=MEMO)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
