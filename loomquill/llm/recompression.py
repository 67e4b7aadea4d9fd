"""Substring dedup by recompression.

Words become names; rounds over the whole corpus then name runs and pairs. In a round every name is of class 0 or
1, and of two neighbours the left one of class 0 and the right one of class 1 merge. Which classes a round takes is
settled by counting, over all documents, how many pairs each of some splits would merge: those that merge most are
sent out, and hold for the whole corpus. Whether two neighbours merge depends on them alone, so equal
substrings have equal symbols but for a margin at each end. Of the symbols whose margins lie in a window the one
of least name is the window's anchor: `repeats` finds the symbols that several places share, with the words
around them, orders what lies around them and compares what is taken to be equal byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .repeats import HELD, Kind, chosen, covered, hashes, keyed, least, lots, mix, repeated, unique_ids, with_spans

#: A run this long is named by its two ends; its inside gives way to them.
RUN = 2
ROUNDS = 2
#: Splits into classes that a round counts.
SPLITS = 2
LAST = np.uint64(2**64 - 1)


def margins(rounds: int) -> tuple[int, int]:
    """Words on the left and, from a symbol's start, on the right that a symbol depends on.

    A word depends on its neighbours, which make a run with it or not. In a round a symbol depends on the symbols
    before and behind it, which have twice as many words each time, and on what these depend on.
    """
    return 2**rounds, 2**rounds + 1


def spaced(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words: what lies between blanks, tabs, line ends and the like."""
    b = np.frombuffer(raw, np.uint8)
    word = np.ones(len(b) + 2, np.int8)
    word[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(word)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, list[bytes], list[int]]:
    """(words joined by single blanks, begin of each and what follows the last, the words, words of each text); an empty word ends each text."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.encode("utf-8", "surrogatepass").split()
        sizes.append(len(own))
        words += own
        words.append(b"")
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return b" ".join(words), at, words, sizes


def values(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers of a dictionary that holds for these spans."""
    words = [s.split() for s in spans]
    number: dict[bytes, int] = {}
    for ws in words:
        for w in ws:
            if w not in number:
                number[w] = len(number)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((number[w] for ws in words for w in ws), np.uint64, int(size.sum())), size


def run_places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in its run, length of its run) of every word."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = ~np.fromiter(map(eq, words[1:], words), bool, max(0, n - 1))
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [n]]))
    return np.arange(n) - np.repeat(first, length), np.repeat(length, length)


def ones(name: np.ndarray, r: int, split: int) -> np.ndarray:
    """Whether names are of class 1 in a round under a split."""
    return (mix(name + np.uint64(0x632BE59BD9B4E019 * (1 + r + 16 * split) % 2**64)) & np.uint64(1)).astype(bool)


def pairs(name: np.ndarray, fixed: np.ndarray, r: int, split: int) -> np.ndarray:
    """Left ends of the pairs that a round merges."""
    one, free = ones(name, r, split), ~fixed
    left = np.zeros(len(name), bool)
    left[:-1] = free[:-1] & free[1:] & ~one[:-1] & one[1:]
    return left


def named(words: list[bytes], at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, whether of a run) of the words: those of runs stay by themselves, and a run's ends have names of their own."""
    t = hashes(words)
    fixed = length >= RUN
    if b"" in words:  # the end of a text merges with nothing
        fixed |= np.fromiter(map(len, words), np.int64, len(words)) == 0
    first, last = fixed & (at == 0), fixed & (at > 0) & (at == length - 1)
    return np.arange(len(t)), mix(t + first.astype(np.uint64) + np.uint64(2) * last.astype(np.uint64)), fixed


def merged(start: np.ndarray, name: np.ndarray, fixed: np.ndarray, r: int, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after one more round."""
    left = np.flatnonzero(pairs(name, fixed, r, split))
    name = name.copy()
    name[left] = mix(name[left] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r + 1) + mix(name[left + 1]))
    keep = np.ones(len(name), bool)
    keep[left + 1] = False
    return start[keep], name[keep], fixed[keep]


def agreed(rows: DataFrame, rounds: int = ROUNDS) -> tuple[int, ...]:
    """The split of each round, by one pass over all texts: in turn the one that merges most pairs, the first of equals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, ...], int] = {}

        def follow(symbols: tuple, path: tuple[int, ...]) -> None:
            for split in range(SPLITS):
                longer = (*path, split)
                sums[longer] = sums.get(longer, 0) + int(np.count_nonzero(pairs(symbols[1], symbols[2], len(path), split)))
                if len(longer) < rounds:
                    follow(merged(*symbols, len(path), split), longer)

        for b in batches:
            for _, lot in lots(b.column(0)):
                words = cut(lot)[2]
                follow(named(words, *run_places(words)), ())
        yield pa.RecordBatch.from_pydict({"path": pa.array([list(p) for p in sums], pa.list_(pa.int32())), "n": pa.array(list(sums.values()), pa.int64())})

    if not rounds:
        return ()
    counted = rows.select("text").mapInArrow(lean(count), "path array<int>, n long").groupBy("path").agg(F.sum("n").alias("n"))
    n_of = {tuple(r.path): r.n for r in counted.collect()}  # SPLITS ** rounds numbers
    splits: tuple[int, ...] = ()
    for _ in range(rounds):
        splits = max(((*splits, x) for x in range(SPLITS)), key=lambda p: n_of.get(p, 0))
    return splits


def kind(splits: tuple[int, ...], window: int = 20, bits: int = 64) -> Kind:
    """A window's anchor: of the symbols whose margins lie in it, the one of least name; windows inside a run have the first alone."""
    before, behind = margins(len(splits))
    reach = window - before - behind + 1
    if reach < 2 ** len(splits) + 2:
        raise ValueError(f"windows of {window} words may hold no symbol of {len(splits)} rounds with its margins")

    def anchors(_: bytes, words: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(words)
        at, length = run_places(words)
        start, name, fixed = named(words, at, length)
        for r, split in enumerate(splits):
            start, name, fixed = merged(start, name, fixed, r, split)
        value = np.full(n, LAST)
        value[start] = np.minimum(mix(name + np.uint64(77)), LAST - np.uint64(1))
        value[(length >= RUN) & (at > 0) & (at < length - 1)] = LAST
        place = least(value[before : n - behind + 1], reach) + before
        alone = (length - at)[: n - window + 1] >= window  # all words of the window are one
        busy = np.flatnonzero(inside & ~alone)
        got, first, last = chosen(place[busy], busy)
        whole = np.flatnonzero(inside & alone & (at[: n - window + 1] == 0))
        parts = ((got - before, whole), (got + behind, whole + window), (first, whole), (last, whole))
        return tuple(np.concatenate(x) for x in parts)

    return Kind(window, cut, anchors, values, gap=1, later=True, bits=bits)


def inner_runs(words: list[bytes], window: int) -> list[dict[str, int]]:
    """Window starts inside one long run, which repeat the run's first window."""
    if len(words) <= window or sum(map(eq, words[1:], words)) < window:
        return []
    at, length = run_places(words)
    heads = np.flatnonzero((at == 0) & (length > window))
    return [{"a": int(i) + 1, "b": int(i + length[i] - window)} for i in heads]


def repeated_words(docs: DataFrame, window: int = 20, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, removed array<struct<start,end>>) of every document.

    A word goes if a window of `window` words that covers it also starts earlier: in a document of smaller id,
    or before it in its own. Windows are judged on the input. kept joins what stays by single blanks. Null and
    empty texts have no words. Rows that repeat under the same id are one document, and keep the same words;
    other texts under the same id follow each other by hash. A null id comes before all others.
    """
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, removed array<struct<start int, end int>>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                rows = []
                for x, found in zip(s.column(1), s.column(2).to_pylist(), strict=True):
                    raw = x.as_py().encode("utf-8", "surrogatepass")
                    words = raw.split()
                    n = len(words)
                    gone = covered([*(found or []), *inner_runs(words, window)], window, n)
                    ends = [0, *(e for _, e in gone)]
                    kept = [w for a, z in zip(ends, [*(a for a, _ in gone), n], strict=True) for w in words[a:z]]
                    joined = b" ".join(kept)
                    rows.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass"), [{"start": a, "end": z} for a, z in gone]))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(span))
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"])

    k = kind(agreed(keyed(docs, id_col, text_col, True), rounds), window, bits)
    return with_spans(docs, k, id_col, text_col, held).mapInArrow(lean(run), out)


def without_repeats(docs: DataFrame, window: int = 50, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, less the words that `repeated_words` removes; what stays keeps its own white space.

    Texts without repeats come out unchanged, null ones too; size_col, where given and present, is counted anew.
    """
    k = kind(agreed(keyed(docs, id_col, text_col, True), rounds), window)
    unique = unique_ids(docs, id_col)
    spans = repeated(docs, k, unique, id_col, text_col).withColumnsRenamed({"id": "_id", "h": "_h", "spans": "_spans"})
    marked = docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "_h": F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    joined = marked.join(spans, ["_id", "_h"], "left").select(*docs.columns, "_spans")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                s = b.slice(i, 1024)
                out = [None if x is None else cleaned(x, found, window) for x, found in zip(s.column(at).to_pylist(), s.column(s.num_columns - 1).to_pylist(), strict=True)]
                cols = [*s.columns[:at], pa.array(out, pa.string()), *s.columns[at + 1 : -1]]
                yield pa.RecordBatch.from_arrays(cols, names)

    kept = joined.mapInArrow(lean(run), docs.schema)
    if size_col and size_col in docs.columns:
        kept = kept.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return kept


def cleaned(text: str, spans: list | None, window: int) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    start, end = spaced(raw)
    n = len(start)
    gone = covered([*(spans or []), *inner_runs(raw.split(), window)], window, n)
    if not gone:
        return text
    out, last = [], 0
    for a, z in gone:
        out.append(raw[last : start[a]])
        last = int(start[z]) if z < n else int(end[n - 1])
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
