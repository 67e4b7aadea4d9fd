"""Quality by hierarchical empirical Bayes.

A logistic model on form features gives each document's own evidence. Grouped sums of the documents'
probabilities give host and path posteriors: a path shrinks toward its host, a host toward the corpus, the
more the fewer documents it has, by strengths taken from the variation between groups. The document's
log-odds then move by its path's log-odds against the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lean, written
from .labelled import fold, sample

FEATURES = ("one", "log_words", "word_len", "distinct", "commonest", "repeats", "symbols", "marked", "digits", "upper", "stops", "bars", "lines", "long")
#: How much of a site's log-odds goes to its documents, which have given that evidence themselves.
SITE_WEIGHT = 0.5
_MARK = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_RUN = re.compile(r"([^\w\s])\1\1")


def features(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    letters = sum(map(len, words))
    return [
        1.0, np.log1p(n), letters / n / 10, len(seen) / n, max(seen.values()) / n, same / n,
        len(_MARK.findall(text)) / chars * 10, len(_RUN.findall(text)) / n, sum(map(text.count, "0123456789")) / chars * 10,
        sum(w[0].isupper() for w in seen) / len(seen), text.count(".") / n * 5, text.count("|") / n * 5, text.count("\n") / n * 10, max(map(len, seen)) / 50,
    ]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Logistic weights (with means and spreads) from folds 0 and 2 of the labels, by Newton steps with a ridge."""
    known = sample(docs, labels, label, (0, 2), id_col, text_col).where("label in (0, 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(x.as_py()) for x in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = known.select("text", "label").mapInArrow(lean(run), "x array<double>, y int").collect()  # a bounded sample
    k = len(FEATURES)
    x = np.asarray([r.x for r in rows], float).reshape(-1, k)
    y = np.asarray([r.y for r in rows], float)
    mean, spread, w = np.zeros(k), np.ones(k), np.zeros(k)
    if len(y) and 0 < y.mean() < 1:
        mean[1:], spread[1:] = x[:, 1:].mean(0), np.maximum(x[:, 1:].std(0), 1e-6)
        z = (x - mean) / spread
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + 1e-1 * w
            h = (z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(k)
            step = np.linalg.solve(h, g)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
    elif len(y):
        w[0] = 5.0 if y.mean() else -5.0
    return np.stack([mean, spread, w])


def evidence(docs: DataFrame, weights: np.ndarray, host_col: str, path_col: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, logit): what each text says for itself."""
    mean, spread, w = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray([features(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.clip((x - mean) / spread @ w, -12, 12))], ["doc_id", "host", "path", "logit"])

    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(lean(run), "doc_id long, host string, path string, logit double")


def strength(n, mean, variance, within):
    """Prior size m(1-m)/between, the between-group variance by moments; 2 to 1000 documents."""
    between = F.greatest(variance - within, F.lit(1e-6))
    return F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(2.0)), F.lit(1000.0))


def posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior, prior) by grouped sums: paths, then hosts, then one corpus row."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "site-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))

    def spread(sums: DataFrame, n: str, s: str) -> tuple[float, float]:
        m = sums.agg((F.sum(s) / F.sum(n)).alias("m")).first().m
        if m is None:
            return 0.5, 100.0
        mean = F.lit(float(m))
        row = sums.agg((F.sum(F.col(n) * (F.col(s) / F.col(n) - mean) ** 2) / F.sum(n)).alias("v"), (F.count("*") * mean * (1 - mean) / F.sum(n)).alias("w"))
        return float(m), float(row.select(strength(None, mean, F.col("v"), F.col("w"))).first()[0])

    prior, a = spread(hosts, "hn", "hs")
    _, b = spread(paths, "n", "s")
    hosts = hosts.select("host", ((F.col("hs") + a * prior) / (F.col("hn") + a)).alias("host_posterior"))
    return paths.join(hosts, "host").select("host", "path", "host_posterior", ((F.col("s") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior"), F.lit(prior).alias("prior"))


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str | None = "lang", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, host, path, evidence, host_posterior, path_posterior, score, predicted) of every document.

    score is the probability of good quality; predicted is 1 from the threshold on. Null and empty texts are
    judged by their lack of words; null hosts and paths are a site of their own; rows that repeat are judged
    each; an empty table gives no rows; without labels every score is 0.5.
    """
    rows = written(evidence(docs, fit(docs, labels, id_col=id_col, text_col=text_col), host_col, path_col, id_col, text_col), "quality-evidence")
    sites = written(posteriors(rows), "quality-sites")
    few = sites.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(sites) if few else sites, ["host", "path"])
    logit = lambda x: F.log(x / (1 - x))
    total = F.col("logit") + SITE_WEIGHT * (logit(F.col("path_posterior")) - logit(F.col("prior")))
    out = joined.withColumn("score", 1 / (1 + F.exp(-total)))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "host", "path", F.col("logit").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
