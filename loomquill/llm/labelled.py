"""Bounded samples of labelled rows, the only thing that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most labelled documents of one fold that a model is fitted on; more change its figures little.
MAX_LABELLED = 20_000


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 3; fold 1 is held out, fold 0 fits counts, fold 2 calibrates."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """(text, label int, fold) of labelled documents of these folds, at most `most` a fold by a hash of the id.

    The sample of ids is bounded by a parameter, so it can be broadcast; null labels, ids and texts are left out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("_id").agg(F.max("label").alias("label"))
    known = known.withColumn("fold", fold("_id"))
    picked = [known.where(F.col("fold") == f).orderBy(F.xxhash64("_id"), "_id").limit(most) for f in folds]
    ids = picked[0]
    for p in picked[1:]:
        ids = ids.union(p)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(ids), "_id").select("text", "label", "fold")
