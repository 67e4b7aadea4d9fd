"""Exact top-k inner products by the three-phase uniform threshold.

The components of a vector are dealt to fragments; every fragment of a pair gives a partial score. Phase one:
each task makes the score list of the first fragments alone, resolves the few best entries of every query's
list exactly and sends those scores in. The k-th best of all that came in is a cutoff that no answer falls
below. Phase two: the cutoffs go out, and each task collects the entries that can still reach them: to a
pair's partial score over the fragments seen the rest can add no more than the product of the lengths of what
is left, so a pair leaves as soon as that falls short. Phase three: the entries left are scored exactly, and
each task keeps k a query. Most pairs are never scored in full, and nothing sent grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, written

#: Queries that are sent out at once, and how many of them a task takes at a time.
BLOCK, AT_ONCE = 32_768, 1024
FRAGMENTS = 8
#: Fragments whose score list phase one makes.
LISTED = 2
#: Entries of that list that phase one resolves, for each entry asked for.
DEPTH = 4
#: Vectors that are scored at once.
ROWS = 1024
#: Below this share of pairs left they are followed one by one; above it, as a matrix.
FEW = 0.15
#: Candidates that a task holds before it keeps the best of them.
HELD = 400_000
#: Sums up to here are exact in doubles.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(b: pa.RecordBatch, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, vectors of whole numbers) of the rows that take part: no null id, vector or component, all components finite."""
    ids, rows = [], []
    for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        if i is None or not v.is_valid:
            continue
        a = v.values
        if a.null_count:
            continue
        a = np.asarray(a.to_numpy(zero_copy_only=False), np.float64)
        if not np.isfinite(a).all():
            continue
        with np.errstate(over="ignore"):
            x = np.floor(a * scale)
        if not np.isfinite(x).all() or np.abs(x).max(initial=0) >= EXACT:
            x = np.array([floor(Fraction(c) * Fraction(scale)) for c in a.tolist()], object)
        ids.append(i)
        rows.append(x)
    return np.asarray(ids, np.int64), rows


def by_length(ids: np.ndarray, rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, r in zip(ids.tolist(), rows, strict=True):
        a, b = out.setdefault(len(r), ([], []))
        a.append(i)
        b.append(r)
    return {n: (np.asarray(a, np.int64), np.stack(b)) for n, (a, b) in out.items()}


def exact(q: np.ndarray, v: np.ndarray) -> bool:
    """Whether doubles hold every sum of q v' exactly."""
    return q.dtype != object and v.dtype != object and (not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT)


def in_integers(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """q v' in Python's integers, cut to what a long holds."""
    whole = np.vectorize(int, otypes=[object])
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    return np.vectorize(lambda s: min(max(s, LEAST), MOST), otypes=[np.int64])(whole(q) @ whole(v).T)


def parts(n: int) -> list[tuple[int, int]]:
    return [(n * f // FRAGMENTS, n * (f + 1) // FRAGMENTS) for f in range(FRAGMENTS)]


def lengths(x: np.ndarray) -> np.ndarray:
    """Length of what is left of each vector behind each fragment: one column a fragment."""
    return np.stack([np.sqrt((x[:, b:] ** 2).sum(1)) for _, b in parts(x.shape[1])], 1)


def listed(q: np.ndarray, v: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase one for some vectors: (query, vector, exact score) of the best of each query's list of the first fragments."""
    b = parts(q.shape[1])[LISTED - 1][1]
    first = q[:, :b] @ v[:, :b].T
    first[own] = -np.inf
    many = min(len(v), k * DEPTH)
    at = np.argpartition(-first, many - 1, axis=1)[:, :many] if many < len(v) else np.broadcast_to(np.arange(len(v)), first.shape)
    j, i = np.repeat(np.arange(len(q)), many), at.reshape(-1)
    on = ~own[j, i]
    j, i = j[on], i[on]
    return j, i, np.einsum("ij,ij->i", q[j], v[i])


def collected(q: np.ndarray, v: np.ndarray, own: np.ndarray, cutoff: np.ndarray, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases two and three for some vectors: (query, vector, exact score) of every pair that reaches its query's cutoff.

    work, if given, has the numbers of partial products and of full ones added to it.
    """
    left_q, left_v = lengths(q), lengths(v)
    score = np.zeros((len(q), len(v)))
    alive = ~own
    j = i = s = None
    for f, (a, b) in enumerate(parts(q.shape[1])):
        if j is None and f and np.count_nonzero(alive) < FEW * alive.size:
            j, i = np.nonzero(alive)
            s = score[j, i]
        if j is None:
            score += q[:, a:b] @ v[:, a:b].T
            if work is not None:
                work[0] += alive.size
            # A little is added against the rounding of lengths; the scores themselves are exact.
            alive &= score + np.outer(left_q[:, f], left_v[:, f]) * (1 + 1e-9) + 1e-3 >= cutoff[:, None]
        else:
            s = s + np.einsum("ij,ij->i", q[j, a:b], v[i, a:b])
            if work is not None:
                work[0] += len(j)
            on = s + left_q[j, f] * left_v[i, f] * (1 + 1e-9) + 1e-3 >= cutoff[j]
            j, i, s = j[on], i[on], s[on]
    if j is None:
        j, i = np.nonzero(alive)
        s = score[j, i]
    on = s >= cutoff[j]
    if work is not None:
        work[1] += int(on.sum())
    return j[on], i[on], s[on]


class Best:
    """The k highest scores of each query among what was added, ties to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.size = k, [], 0

    def add(self, j: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        if len(j):
            self.held.append((j.astype(np.int64), ids.astype(np.int64), s.astype(np.int64)))
            self.size += len(j)
            if self.size > HELD:
                self.held = [self.kept()]
                self.size = len(self.held[0][0])

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.empty(0, np.int64),) * 3
        j, ids, s = (np.concatenate([h[c] for h in self.held]) for c in range(3))
        order = np.lexsort((ids, -s, j)) if s.min() > LEAST else np.lexsort((ids, -(s.astype(np.float64)), j))
        j, ids, s = j[order], ids[order], s[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(j)) + 1])
        place = np.arange(len(j)) - np.repeat(first, np.diff(np.append(first, len(j))))
        on = place < self.k
        return j[on], ids[on], s[on]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product.

    Queries are the rows whose id is divisible by `every`. Rows with a null id, a null vector or null or
    non-finite components take no part; vectors of another length than the query's aren't its candidates; a row
    never answers a query of its own id; rows that repeat count each. Fewer candidates give fewer rows. Scores
    that a long can't hold are given as its least or greatest value, tied. An empty table gives no rows.

    Queries go out in blocks of bounded size, whatever their ids; each block reads the vectors twice, and its
    answers are written before the next one.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = base.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    # Numbers that are written once: rows of one id are dealt to all blocks.
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "asked")
    path = fresh_path(spark, "answers")
    schema = "query long, row long, vec_id long, score long"
    for i in range(blocks):
        _one_block(base, asked.where(F.col("block") == i).select("id", "v"), i, k, scale, path)
    found = spark.read.schema(schema).parquet(path)
    w = Window.partitionBy("query", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def _one_block(base: DataFrame, asked: DataFrame, number: int, k: int, scale: float, path: str) -> None:
    spark = base.sparkSession
    got = [quantised(b, scale) for b in asked.toArrow().combine_chunks().to_batches()]  # about `block` rows
    queries = by_length(np.concatenate([i for i, _ in got] or [np.empty(0, np.int64)]), [r for _, rows in got for r in rows])
    shared = spark.sparkContext.broadcast(queries)

    def slices(batches: Iterator[pa.RecordBatch]):
        """(length, place of the first query, their ids, queries, vector ids, vectors, which pairs are of one id)."""
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for n, (ids, v) in by_length(*quantised(b.slice(at, ROWS), scale)).items():
                    if n in shared.value:
                        qids, q = shared.value[n]
                        for start in range(0, len(qids), AT_ONCE):
                            some = slice(start, start + AT_ONCE)
                            yield n, start, q[some], ids, v, qids[some][:, None] == ids[None, :]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for n, start, q, ids, v, own in slices(batches):
            if n and exact(q, v):
                j, i, s = listed(q, v, own, k)
                best.setdefault(n, Best(k)).add(j + start, ids[i], s)
        for n, b in best.items():
            j, _, s = b.kept()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), n, np.int32)), pa.array(j), pa.array(s)], ["n", "j", "s"])

    lists = base.mapInArrow(lean(gather), "n int, j long, s long")
    place = F.row_number().over(Window.partitionBy("n", "j").orderBy(F.desc("s")))
    cutoff = {n: np.full(len(i), -np.inf) for n, (i, _) in queries.items()}
    for r in lists.withColumn("r", place).where(F.col("r") == k).select("n", "j", "s").collect():  # a number a query of the block
        cutoff[r.n][r.j] = r.s
    sent = spark.sparkContext.broadcast(cutoff)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for n, start, q, ids, v, own in slices(batches):
            if n and exact(q, v):
                j, i, s = collected(q, v, own, sent.value[n][start : start + len(q)])
            else:  # beyond doubles, or without components: all pairs, in integers
                j, i = np.nonzero(~own)
                s = in_integers(q, v)[j, i]
            best.setdefault(n, Best(k)).add(j + start, ids[i], s)
        for n, b in best.items():
            j, ids, s = b.kept()
            row = (np.int64(number) << np.int64(40)) + (np.int64(n) << np.int64(20)) + j
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][j]), pa.array(row), pa.array(ids), pa.array(s)], ["query", "row", "vec_id", "score"])

    base.mapInArrow(lean(resolve), "query long, row long, vec_id long, score long").write.mode("append").parquet(path)
    sent.destroy()
    shared.destroy()
