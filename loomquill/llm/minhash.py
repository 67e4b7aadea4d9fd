"""Near duplicates: every pair of texts whose five-word shingles are 0.8 similar (Jaccard), checked on the whole sets.

Candidates come by two ways, under the same check. By SimHash: texts whose fingerprints differ in few bits, found by
the bit counts of segments (`simhash.links`, which joins each group by a spanning forest, so not all its pairs are
tried), and those of one fingerprint with its first text. SimHash loses copies whose edit lies in one place, so
candidates are also texts that agree in all rows of one of many MinHash bands. How likely that is depends on the
similarity alone, not on where a text was edited: at 0.8 all bands miss a pair once in 150,000, above it more rarely. A
text is compared with the candidate that it meets most often, then with the others where no link has joined them yet;
in each band's cell all are candidates of the first one. Then those of a cell that aren't linked yet are compared with
each other, so a cell of many copies costs one comparison each and yet no pair of a cell is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import lean, partitions, texts, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 30, 5
#: Bits in which the SimHash fingerprints of candidates differ at most.
REACH = 4
#: Similarity asked for, as a fraction.
LEAST = (4, 5)
#: Of the BANDS * ROWS bytes of two signatures so many must agree before the sets are compared: at 0.8, 120 do on
#: average, with a deviation of 4.9; fewer than this come once in 10^7.
AGREE = 93
#: Shingle sets up to this size go with their text to its cells and are compared there; pairs with a larger one meet in a join.
HERE = 2_000
_R = np.random.default_rng(42)
_MASK = _R.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_ODD = _R.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _R.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_LAST = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """XXH64 of each run of five words, in lower case; of the whole text if it has fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    whole, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(whole)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def signature(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(cell of each band, a byte of each row) of a text's shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 256):
        np.minimum(least, ((h[None, at : at + 256] ^ _MASK) * _ODD).min(1), out=least)
    band = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    band = (band ^ (band >> np.uint64(31))) * _LAST
    return band.view(np.int64), ((least * _LAST) >> np.uint64(56)).astype(np.uint8).tobytes()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, key): rows of the same text share a key."""
    return texts(docs, id_col, text_col).withColumn("key", F.md5("text"))


def across(group: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): each pair of different groups whose signatures agree enough, once."""
    names, inverse, times = np.unique(group, return_inverse=True, return_counts=True)
    large = inverse == times.argmax()
    for i in np.flatnonzero(~large).tolist():
        js = np.flatnonzero((inverse != inverse[i]) & (large | (np.arange(len(group)) > i)))
        for at in range(0, len(js), 10_000):
            part = js[at : at + 10_000]
            yield i, part[(sig[part] == sig[i]).sum(1) >= AGREE]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are LEAST similar; sets of sizes too far apart aren't looked at."""
    p, q = LEAST
    if min(len(x), len(y)) * q < max(len(x), len(y)) * p:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) * (p + q) >= (len(x) + len(y)) * p


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, component) of every text that a row with an id has: the texts joined by pairs of LEAST similarity."""
    rows = keyed(docs, id_col, text_col).where("doc_id is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [signature(shingles(x.as_py())) for x in b.column(1)]
            cells = pa.array([c for c, _ in got], pa.list_(pa.int64()))
            fp = np.fromiter((simhash.simhash(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            columns = [b.column(0), b.column(2), cells, pa.array([s for _, s in got], pa.binary()), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "cells", "sig", "fp"])

    signed = rows.mapInArrow(lean(sign), "doc_id long, key string, cells array<long>, sig binary, fp long")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("cells", "sig", "fp")))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "signatures")

    met = nodes.select("node", F.posexplode("cells").alias("band", "cell"))
    heads = met.groupBy("band", "cell").agg(F.min("node").alias("head"), F.max("node").alias("_last")).where("head <> _last").drop("_last")
    crowd = written(met.join(heads, ["band", "cell"]), "crowd")

    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    near = simhash.links(prints, REACH).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("head"))
    same = nodes.select("fp", "node").join(prints.select("fp", F.col("node").alias("head")), "fp").where("node <> head").select("node", "head")
    by_bits = written(near.union(same).groupBy("node", "head").agg(F.count("*").alias("times")), "by-bits")
    members = crowd.select("node").union(by_bits.select("node")).union(by_bits.select("head")).distinct().join(nodes.select("node", "doc_id", "key"), "node")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [np.unique(shingles(x.as_py())).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    held = rows.join(members, ["doc_id", "key"]).select("node", "text").mapInArrow(lean(whole), "node long, s array<long>")
    sets = written(held.dropDuplicates(["node"]).withColumn("n", F.size("s")), "shingle-sets")

    def similar(pairs: DataFrame) -> DataFrame:
        p, q = LEAST
        x, y = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)
        return written(both.where(F.size(F.array_intersect("sa", "sb")) * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b"), "similar")

    # Each text is compared with the candidate that it shares most cells with, of both kinds; then with the others that this has not joined it to.
    by_bands = crowd.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("times"))
    shared = by_bands.union(by_bits).groupBy("node", "head").agg(F.sum("times").alias("times"))
    likest = written(shared.groupBy("node").agg(F.min_by("head", F.struct(-F.col("times"), F.col("head"))).alias("a")), "likest")
    first = similar(likest.select("a", F.col("node").alias("b")))
    joined = written(components(first), "joined")
    other = shared.join(likest, "node").where("head <> a").join(joined.select("node", F.col("component").alias("cn")), "node", "left")
    other = other.join(joined.select(F.col("node").alias("head"), F.col("component").alias("ch")), "head", "left")
    other = other.where(F.coalesce("cn", "node") != F.coalesce("ch", "head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    first = first.union(similar(other))
    named = crowd.join(components(first), "node", "left").select("band", "cell", "head", "node", F.coalesce("component", "node").alias("grp"))
    mixed = named.groupBy("band", "cell").agg(F.min("grp").alias("_a"), F.max("grp").alias("_z")).where("_a <> _z").select("band", "cell")
    small = nodes.select("node", "sig", "cells").join(sets.select("node", F.when(F.col("n") <= HERE, F.col("s")).alias("s")), "node")
    left = named.join(mixed, ["band", "cell"]).join(small, "node").select("band", "cell", "node", "grp", "sig", "cells", "s", (F.col("node") == F.col("head")).alias("is_head"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            band, cell = (t.column(c).to_numpy() for c in ("band", "cell"))
            cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(cell) != 0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from found(t.slice(0, last), [0, *cuts.tolist()])
            held = t.slice(last)
        if held is not None:
            yield from found(held, [0, held.num_rows])

    def found(t: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        node, grp, head, band = (t.column(c).to_numpy() for c in ("node", "grp", "is_head", "band"))
        cells, own = t.column("cells").combine_chunks(), t.column("s").combine_chunks()
        cells = cells.flatten().to_numpy().reshape(-1, BANDS)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z > t.num_rows:
                break
            for i, js in across(grp[a:z], sig[a:z]):
                js = js[~head[a:z][js]] if not head[a + i] else js[:0]  # the first one was compared with all
                # A pair is looked at in the first of the cells that it shares.
                js = js[(cells[a:z][js] == cells[a + i]).argmax(1) == band[a + i]] if len(js) else js
                if len(js):
                    mine = own[a + i]
                    checked = [not (mine.is_valid and own[a + j].is_valid) for j in js.tolist()]
                    same = [c or alike(mine.values.to_numpy(), own[a + j].values.to_numpy()) for c, j in zip(checked, js.tolist(), strict=True)]
                    js, checked = js[same], np.asarray(checked)[same]
                    x, y = np.full(len(js), node[a + i]), node[a:z][js]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(~checked)], ["a", "b", "linked"])

    dealt = left.repartition(partitions(docs.sparkSession), "band", "cell").sortWithinPartitions("band", "cell")
    more = written(dealt.mapInArrow(lean(meet), "a long, b long, linked boolean"), "met")
    more = more.where("linked").select("a", "b").union(similar(more.where("not linked").select("a", "b")))
    joined = components(first.union(more))
    return nodes.join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
