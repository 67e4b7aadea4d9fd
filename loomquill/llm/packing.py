"""Best-fit packing by minimum bin slack.

Pieces differ in their length alone, and there are at most `capacity` lengths, so the plan is made from
the counts by length: per bin, subset-sum dynamic programming over a bitset of sums finds the fullest
combination that holds the longest piece left, and that combination is taken out as many times as the
counts allow. Which piece goes where follows from its rank among those of its length: a prefix sum over
the partitions' counts, so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, texts, written
from .words import MEMO, word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies of each length, of those available, whose sum is the largest up to room; longer lengths are preferred."""
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            chunk = min(chunk, left)
            steps.append((length, chunk, sums))
            sums |= sums << length * chunk & mask
            left -= chunk
            chunk *= 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, chunk, had in reversed(steps):
        if not had >> at & 1:
            used[length] = used.get(length, 0) + chunk
            at -= length * chunk
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, copies in each of these bins)])]; every piece is in exactly one bin."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        out.append((bins, sorted(used.items(), reverse=True)))
    return out


def lookup(planned: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): bin and offset of a piece follow from its rank among its length."""
    rows, ranks, base = [], {}, 0
    for bins, used in planned:
        offset = 0
        for length, copies in used:
            rows.append((length, ranks.get(length, 0), base, copies, offset))
            ranks[length] = ranks.get(length, 0) + bins * copies
            offset += length * copies
        base += bins
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "base", "copies", "offset"), table.T, strict=True))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """The pieces of every document, with the partition that made each and its rank there among its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, tail = word_encoder(tokenizer_path, memo), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), w.encode_all(x.as_py() for x in b.column(1)), strict=True):
                raw = ids + tail
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(lean(run, keeps=True), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null and empty texts are a piece of the end id alone; rows that repeat are packed each; an empty table
    gives no pieces. What reaches the driver is one count for each length, at most `capacity` rows. memo: the entries that
    a worker remembers of words; fewer take less memory and more time.
    """
    with small_batches(docs.sparkSession):  # the texts are read in here
        made = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, memo), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = lookup(plan(by_length, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = 1 << 44
        keys = found["length"] * big + found["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * big + rank, side="right") - 1
            nth = rank - found["rank"][at]
            copies = found["copies"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found["base"][at] + nth // copies), pa.array(found["offset"][at] + nth % copies * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids array<int>) of a packing, for documents whose ids are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tail = word_encoder(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(w.encode(text.as_py()) + tail, "<u4").astype("<i4")
                cuts = [raw[at : at + capacity] for at in range(0, len(raw), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    cut = texts(docs, id_col, text_col).mapInArrow(lean(run, keeps=True), "doc_id long, piece int, ids array<int>")
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # one sequence: at most `capacity` ids
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
