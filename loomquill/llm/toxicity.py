"""Toxic passages by maximum-scoring segments.

A text counts each of its tokens once. Toxic and clean texts are two multinomials over tokens, and a token's score is
the logarithm of its share in one against its share in the other, less a drift. The Dirichlet prior of a token is its
word stem, whose prior is a shorter stem, whose prior is no evidence: given how often a token comes in both classes,
the ratio of its shares has a Beta posterior about the stem's. So inflected forms that were never seen lean on their
stem. One linear scan over the scores of all tokens, for and against, finds all maximal segments of a document, the
passages that no extension or split improves. How high a segment can score by chance in a text of that length follows
an extreme-value law, fitted on clean labelled texts; a document's score is the posterior from its best segments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, texts, written
from .labelled import fold, sample

TOKEN = re.compile(r"\w+")
#: Lengths of the stems that serve as priors, from the weakest.
STEMS = (4, 5)
#: Strength of a Dirichlet prior, in tokens.
STRENGTH = 8.0
#: What a word's score for toxicity is multiplied by each time that it comes again in a document: repeats aren't independent.
FADE = 0.5
#: Taken off every token's log-odds, so that the expected score is negative and passages end.
DRIFT = 1.0
#: Segments of a document that the sum statistic looks at. More weak ones count no more: among many sums some are high
#: by chance (with 50 in place of 4, 50 of 6,230 clean held-out documents of check_s were flagged in place of 1).
BEST = 4
MEMO = 120_000
#: Tokens that every text is taken to have besides its own: chance is no smaller in a very short one.
EDGE = 200
#: More evidence than this, as a log, changes nothing.
SUREST = 40.0


@dataclass
class Table:
    """Log-odds of every word or stem of the labelled sample, by its 64-bit hash: 16 bytes each."""

    keys: np.ndarray  # sorted
    odds: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds, whether known) of hashes."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.odds[at], 0.0), known


def hashes(words: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words), np.uint64, len(words)).view(np.int64)


@dataclass
class Model:
    odds: list[Table]  # by stem of each length in STEMS, then by word
    lam: float
    log_k: float
    slope: float = 1.0  # of the posterior's log-odds, by the log of the chance value
    offset: float = 0.0

    def tokens(self, words: list[str]) -> list[float]:
        got, known = self.odds[-1].find(hashes(words))
        for table, n in zip(reversed(self.odds[:-1]), reversed(STEMS), strict=True):
            at = [i for i in np.flatnonzero(~known).tolist() if len(words[i]) > n]
            got[at], known[at] = table.find(hashes([words[i][:n] for i in at]))
        return (got - DRIFT).tolist()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score) of a sequence.

    Linear: sums up to each place come first; then each positive place is pushed once, and a push removes what it merges with.
    """
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    up = np.flatnonzero(scores > 0)
    after = np.cumsum(scores)[up]
    for i, left, total in zip(up.tolist(), (after - scores[up]).tolist(), after.tolist(), strict=True):
        start = i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= total:
                out.append((start, i + 1, left, total))
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, z - left) for a, b, left, z in out]


def scan(text: str, scores_of, memo: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """(number of tokens, maximal segments) of a text."""
    words = TOKEN.findall(text.lower())
    new = set(words).difference(memo)
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = set(words)
    if new:
        new = list(new)
        memo.update(zip(new, scores_of(new), strict=True))
    found = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    times: dict[str, int] = {}
    for i in np.flatnonzero(found > 0).tolist():
        k = times[words[i]] = times.get(words[i], -1) + 1
        found[i] *= FADE ** min(k, 60)
    return len(words), segments(found)


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    """log of the chance value of the best r segments together, least over r (sum statistic of extreme values)."""
    base = math.log(n + EDGE) + model.log_k
    x, least = 0.0, base
    for r, s in enumerate(sorted((s for *_, s in found), reverse=True)[:BEST], 1):
        x += model.lam * s - base
        if r > 1 and x <= r:  # the sum's law holds in its tail only
            break
        least = min(least, -x + ((r - 1) * math.log(x) - math.lgamma(r + 1) - math.lgamma(r) if r > 1 else 0.0))
    return least


def posterior(model: Model, log_e: float) -> float:
    return 1.0 / (1.0 + math.exp(min(50.0, max(-50.0, -model.slope * min(SUREST, -log_e) - model.offset))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts of folds 0 and 2; the extreme-value law and the posterior from each fold's scores under the other's counts.

    Without labels of both classes nothing is toxic.
    """
    known = written(sample(docs, labels, label, (0, 2), id_col, text_col).where(F.col("label").isin(0, 1)), "toxic-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], list[int]] = {}
        for b in batches:
            for x, y, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for w in set(TOKEN.findall(x.lower())):
                    seen.setdefault((f, w), [0, 0])[y] += 1
            if len(seen) > MEMO:
                yield rows(seen)
                seen = {}
        yield rows(seen)

    def rows(seen: dict[tuple[int, str], list[int]]) -> pa.RecordBatch:
        cols = ([w for _, w in seen], [f for f, _ in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["w", "fold", "c", "t"])

    picked = known.select("text", "label", F.col("fold").cast("int").alias("fold"))
    counts = picked.mapInArrow(lean(count), "w string, fold int, c long, t long").groupBy("w", "fold").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    counts = written(counts, "toxic-counts")

    def tables(*folds: int) -> list[Table]:
        some = counts.where(F.col("fold").isin(*folds)).groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
        total = some.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
        if not total.c or not total.t:
            return [Table(np.empty(0, np.int64), np.empty(0)) for _ in (*STEMS, None)]
        return odds(some, math.log(total.c / total.t))

    model = Model([], 1.0, 0.0)
    got = []
    for fitted, judged in ((0, 2), (2, 0)):
        model.odds = tables(fitted)
        got += calibrate_on(picked.where(F.col("fold") == judged).select("text", "label"), model)
    y, n, s = (np.asarray([r[i] for r in got], float) for i in range(3))
    if (y == 1).any() and (y == 0).sum() >= 20:
        # Karlin's lambda is 1 for log-odds without drift; a Gumbel law's median and 0.98 point lie 3.5354 / lambda apart.
        middle, upper = np.quantile(s[y == 0], [0.5, 0.98])
        model.lam = min(1.0, 3.5354 / max(float(upper - middle), 1e-3))
        model.log_k = float(np.median((model.lam * s - np.log(n + EDGE))[y == 0])) + math.log(math.log(2))
        x = np.minimum(SUREST, [-evidence(model, int(r.n), [(0, 0, v) for v in r.best]) for r in got])
        model.slope, model.offset = platt(x, y)
    elif not (y == 1).any():
        model.offset = -50.0
    model.odds = tables(0, 2)
    return model


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, to targets that leave room for one error in each class."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    z, w = np.stack([x, np.ones(len(x))], 1), np.array([0.5, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(h, z.T @ (p - t) + 1e-3 * w), -1, 1)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return max(float(w[0]), 0.05), float(w[1])


def odds(counts: DataFrame, share: float) -> list[Table]:
    """Log-odds by stem and word from (w, c, t), how often each comes in clean and toxic texts; share: log of clean to toxic tokens."""
    out: list[Table] = []
    for n in (*STEMS, None):
        key = F.col("w") if n is None else F.substring("w", 1, n)
        got = counts.groupBy(key.alias("w")).agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
        stems = [F.when(F.length("w") > m, F.xxhash64(F.substring("w", 1, m))).alias(f"s{m}") for m in STEMS[: len(out)]]
        got = got.select(F.xxhash64("w").alias("h"), "c", "t", *stems).toArrow()
        h, c, t = (got.column(x).to_numpy() for x in ("h", "c", "t"))
        up = np.zeros(len(h))
        for m, above in zip(STEMS, out, strict=False):  # the longest stem counts; the sample has every stem of its words
            at = np.flatnonzero(got.column(f"s{m}").is_valid().to_numpy())
            up[at] = above.find(got.column(f"s{m}").drop_null().to_numpy())[0]
        mean = 1 / (1 + np.exp(share - up))
        p = (t + STRENGTH * mean) / (c + t + STRENGTH)
        order = np.argsort(h)
        out.append(Table(h[order], (np.log(p / (1 - p)) + share)[order]))
    return out


def calibrate_on(known: DataFrame, model: Model) -> list:
    """(label, tokens, best score, best scores) of each text of a bounded sample."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for b in batches:
            got = [scan(x.as_py(), shared.value.tokens, memo) for x in b.column(0)]
            tops = [sorted((s for *_, s in f), reverse=True)[:BEST] for _, f in got]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([t[0] if t else 0.0 for t in tops], pa.float64()), pa.array(tops, pa.list_(pa.float64()))], ["y", "n", "s", "best"])

    return known.mapInArrow(lean(run), "y int, n long, s double, best array<double>").collect()


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, segments): passages as (start, end) token places with their score.

    Null and empty texts score near 0 and have no passage; rows that repeat are scored each; a null id is kept.
    Only passages that alone would pass the threshold are listed. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # every word of a bounded sample, 16 bytes each
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        m = shared.value
        for b in batches:
            p, kept = [], []
            for x in b.column(1):
                n, found = scan(x.as_py(), m.tokens, memo)
                p.append(posterior(m, evidence(m, n, found)))
                kept.append([{"start": a, "end": e, "score": s} for a, e, s in found if posterior(m, evidence(m, n, [(a, e, s)])) >= threshold])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(v >= threshold) for v in p], pa.int32()), pa.array(kept, pa.list_(passage))], ["doc_id", "score", "predicted", "segments"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double, predicted int, segments array<struct<start int, end int, score double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, segments) of every document, fitted on folds 0 and 2 of the labels."""
    return score(docs, fit(docs, labels), threshold).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "segments")
