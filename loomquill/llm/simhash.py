"""SimHash near-duplicates by segment bit counts.

A fingerprint of 64 bits is mapped to the bit counts of 32 segments of two bits. Two fingerprints that
differ in d bits have counts at Manhattan distance d at most. The segments form three blocks, so for d up
to 4 one block is at distance 0 or 1: each fingerprint is at home in its own cell of each block's grid and
visits the cells that lie one count higher; every pair within reach meets in a cell, where the
differing bits are counted. A cell passes on a spanning forest of its links, never all its pairs.

Blocks have a fixed number of cells, so cells fill up as fingerprints grow in number. A cell that holds more than a
task should compare is parted by the grids of the two other blocks: of these one is at distance 2 or less, so
two fingerprints whose counts are 2 apart or less meet in the cell that lies between them, as each visits all
cells one count away from its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lean, texts, written
from .components import components

SEGMENTS = ((0, 11), (11, 22), (22, 32))
#: The blocks above find all pairs up to this distance: three blocks at distance 2 or more make 6.
REACH = 5
#: Fingerprints of a cell, guests included, that one task compares; cells with more are parted.
MOST = 20_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str, shingle: int = 4, seed: int = 42, distinct: bool = False) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the shingles (each once, if distinct); 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    if distinct:
        h = np.unique(h)
    lanes = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, fp long")


def counted(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, a row a fingerprint."""
    pairs = (fp[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    return np.bitwise_count(pairs).astype(np.int64)


def cells(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(cells, places, home): the grid cells of fingerprints, first their own, then those one count higher."""
    counts = counted(fp)
    for k, (a, b) in enumerate(SEGMENTS):
        weight = 3 ** np.arange(b - a, dtype=np.int64)
        own = counts[:, a:b] @ weight * len(SEGMENTS) + k
        yield own, np.arange(len(fp)), True
        for i in range(a, b):
            at = np.flatnonzero(counts[:, i] < 2)
            yield own[at] + weight[i - a] * len(SEGMENTS), at, False


def inner_cells(cell: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, places): a cell's parts by the two blocks that it isn't of, those of a fingerprint and all one count away."""
    counts = counted(fp)
    for k, (a, b) in enumerate(SEGMENTS):
        at = np.flatnonzero(cell % len(SEGMENTS) != k)
        weight = 3 ** np.arange(b - a, dtype=np.int64)
        own = (counts[at, a:b] @ weight * len(SEGMENTS) + k) + ((cell[at] + 1) << np.int64(24))
        yield own, at
        for i in range(a, b):
            for step in (-1, 1):
                on = (counts[at, i] + step >= 0) & (counts[at, i] + step <= 2)
                yield own[on] + step * weight[i - a] * len(SEGMENTS), at[on]


def forest(home: np.ndarray, guest: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Links (i, j), i among the homes and j in homes + guests, that join what lies within reach; no pair list is built."""
    m = len(home)
    links: list[tuple[int, int]] = []
    group = np.full(m, -1)
    left = np.arange(m)
    groups = 0
    while len(left):
        queue, left = [int(left[0])], left[1:]
        group[queue[0]] = groups
        while queue:
            i = queue.pop()
            if not len(left):
                break
            near = np.bitwise_count(home[left] ^ home[i]) <= reach
            if near.any():
                hit = left[near]
                links += [(i, int(j)) for j in hit]
                group[hit] = groups
                queue += hit.tolist()
                left = left[~near]
        groups += 1
    if len(guest):
        met: set[tuple[int, int]] = set()
        step = max(1, 2_000_000 // max(1, len(guest)))
        for at in range(0, m, step):
            i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ guest[None, :]) <= reach)
            for x, y in zip((i + at).tolist(), j.tolist(), strict=True):
                if (key := (int(group[x]), y)) not in met:
                    met.add(key)
                    links.append((x, m + y))
    return links


GRID = "cell long, guest byte, fp long, node long"


def links(nodes: DataFrame, reach: int = 4, most: int = MOST) -> DataFrame:
    """(a, b) of nodes (fp, node): enough links within reach to join all that is reachable."""
    if reach > REACH:
        raise ValueError(f"the grid's blocks are made for at most {REACH} differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = (b.column(i).to_numpy() for i in (0, 1))
            for cell, at, home in cells(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(at), int(not home), np.int8)), pa.array(fp[at]), pa.array(node[at])], ["cell", "guest", "fp", "node"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, n = np.unique(np.concatenate([c for c, _, _ in cells(b.column(0).to_numpy().view(np.uint64))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, guest, fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for inner, at in inner_cells(cell, fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (inner, guest[at], fp[at], node[at])], ["cell", "guest", "fp", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
            held = [c[last:] for c in cols]
            yield from found([c[:last] for c in cols])
        if held is not None:
            yield from found(held)

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, guest, fp, node = cols
        fp = fp.view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = b - a - int(guest[a:b].sum())
            if m == 0 or b - a < 2:
                continue
            for i, j in forest(fp[a : a + m], fp[a + m : b], reach):
                out.append((int(node[a + i]), int(node[a + j])))
        if out:
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    grid = nodes.select("fp", "node").mapInArrow(lean(spread), GRID)
    full = nodes.select("fp").mapInArrow(lean(sizes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    full = written(full.select("cell"), "full-cells")
    n = full.count()
    if n:
        named = F.broadcast(full) if n <= BROADCAST_ROWS else full
        parted = grid.join(named, "cell", "left_semi").select("cell", "guest", "fp", "node").mapInArrow(lean(part), GRID)
        grid = grid.join(named, "cell", "left_anti").select("cell", "guest", "fp", "node").union(parted)
    return grid.repartition("cell").sortWithinPartitions("cell", "guest").mapInArrow(lean(meet), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, reach: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Texts without words share fingerprint zero; equal fingerprints meet as one node before any pair is
    looked at; rows that repeat fall together; a null id is kept and its component is that of its fingerprint,
    null if no document with an id has it. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "simhashes")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    joined = components(links(nodes, reach))
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
