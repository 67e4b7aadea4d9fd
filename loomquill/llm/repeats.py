"""Exact repeated windows of a fixed number of tokens, without sorting every suffix of the corpus.

1. Each document names anchors: places that depend on the tokens of one window alone, at least one in every
   window. Windows that are equal hold the same anchor, so only suffixes near an anchor seen twice can repeat.
   Text that repeats with a short period, or a line that a document has many times, gives one context again and
   again: these are compared in the document itself, byte by byte, and it tells the corpus of them once.
2. Anchors are counted by their hash; of those seen twice, occurrences with the same surroundings (all windows
   whose anchor it is) are one context, by two 64-bit hashes. Windows of a context that occurs twice repeat:
   what lies next to each other in both documents is put together to runs, and every run is compared with the run
   that it is taken to repeat in another document or place, byte by byte. Should one differ, all is done again under other hashes.
3. Where an anchor has several contexts, the suffixes of one occurrence of each are ordered through the window's
   tokens alone by most-significant-digit passes, singletons going after each pass; equal groups, whose tokens
   are compared, are the repeated windows. An anchor with more contexts than a task should hold is parted by
   longer anchors: a window reaches half of what it lacks to the left of the anchor or to the right, so that
   half is the next digit. The passes go on, over the cluster, until groups are small or the digits spell the
   window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, lean, release, remove, spread_join, written

#: Contexts of one anchor that a task orders in memory; anchors with more are parted first.
HELD = 10_000
#: Suffixes that are ordered at once.
AT_ONCE = 400_000
#: Characters of texts that are looked at together, at least.
LOT = 1 << 19
#: Tokens of a run that are compared as one piece, at most.
PIECE = 8192
#: How often the work is done under other hashes before an error is raised.
TRIES = 20

#: One row for equal contexts of a document: c0 is where the first begins, more where others of the same bytes do
#: (null: nowhere); n tokens, the anchor of l tokens o behind their begin.
ANCHORS = "ah long, ch long, id long, h long, c0 int, n int, o int, l int, more array<int>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16) * 2
        for k, s in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            f = np.full(size, s, np.uint64)
            f[0] = 1
            _powers[k] = np.cumprod(f)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _power(len(values))[0], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Quick hash of values[start:end], alike at every place, from prefix sums. It chooses places and sorts; it never decides that tokens are equal."""
    return mix((p[end] - p[start]) * _power(len(p))[1][start] + (end - start).astype(np.uint64))


#: Bits of a place beside a hash: texts have fewer tokens than that.
PLACE = np.uint64(2**31 - 1)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash of each run of `width` places, the leftmost of equal ones."""
    x = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    return (x & PLACE).astype(np.int64)


def chosen(place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first and last window) of each run of neighbouring windows that have chosen the same place."""
    if not len(place):
        return (np.empty(0, np.int64),) * 3
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(window) != 1)) + 1
    first = np.concatenate([[0], new])
    return place[first], window[first], window[np.concatenate([new, [len(place)]]) - 1]


def hashes(spans: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each."""
    digests = map(xxhash.xxh64_intdigest, spans, repeat(seed)) if seed else map(xxhash.xxh64_intdigest, spans)
    return np.fromiter(digests, np.uint64, len(spans))


@dataclass(frozen=True)
class Kind:
    """What the texts are cut into.

    cut: texts to (bytes of all, begin of every token in them and what follows the last one, the tokens themselves if
    anchors needs them, tokens of each text); where tokens have a gap between them, an empty one stands behind each
    text. anchors: bytes, tokens and whether each window lies in one text to (starts, ends of anchor regions, first and
    last windows whose anchors they are), in tokens. values: bytes of several spans to (a number for every token,
    tokens of each), equal for equal tokens alone. gap: bytes between two tokens.
    """

    window: int
    cut: Callable[[list[str]], tuple[bytes, np.ndarray, list[bytes], list[int]]]
    anchors: Callable[[bytes, list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    values: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    gap: int
    later: bool  # a window must start later than an equal one; else an equal one anywhere else will do
    bits: int = 64  # of the first try's hashes; fewer are for tests

    def spans(self, raw: bytes, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [raw[a:b] for a, b in zip(at[start].tolist(), (at[end] - self.gap).tolist(), strict=True)]

    def names(self, spans: list[bytes], seed: int) -> np.ndarray:
        out = hashes(spans, seed)
        return (out >> np.uint64(64 - self.bits) if self.bits < 64 and seed < 2 else out).view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str, unique: bool) -> DataFrame:
    """(doc_id, id, h, text): id and h name a document; h is a hash of the text where ids alone don't tell rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.lit(0).cast("long") if unique else F.xxhash64(text)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), h.alias("h"), text.alias("text"))


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(id_col).count().where("count > 1").isEmpty()


def once(doc: np.ndarray, ah: np.ndarray, ch: np.ndarray, n: np.ndarray, o: np.ndarray, c0: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(the first of each context of each document, [(its number among these, places of the others)]).

    Others have the bytes of the first, not its hashes alone: each is compared with the one before it.
    """
    key = mix(ah.view(np.uint64) + mix(doc.astype(np.uint64) + _STEP))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return np.arange(len(ah)), []
    again = np.isin(doc, np.unique(doc[order[same]]))  # of these documents all contexts are looked at
    at = np.flatnonzero(again)
    order = at[np.lexsort((c0[at], o[at], n[at], ch[at], ah[at], doc[at]))]
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x[order]) != 0 for x in (doc, ah, ch, n, o)], axis=0)
    for i in np.flatnonzero(~new).tolist():
        new[i] = spans[order[i]] != spans[order[i - 1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order))
    alone = np.flatnonzero(~again)
    more = [(len(alone) + int(i), c0[order[first[i] + 1 : last[i]]].astype(np.int32)) for i in np.flatnonzero(last - first > 1)]
    return np.concatenate([alone, order[first]]), more


def lots(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of about LOT characters, so that arrays are long and memory is bounded."""
    lot, size, start = [], 0, 0
    for i, x in enumerate(texts):
        lot.append(x.as_py())
        size += len(lot[-1])
        if size >= LOT:
            yield start, lot
            lot, size, start = [], 0, i + 1
    if lot:
        yield start, lot


def anchors(rows: DataFrame, kind: Kind, seed: int = 0) -> DataFrame:
    w = kind.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_, h = (b.column(i).to_numpy() for i in (0, 1))
            for place, lot in lots(b.column(2)):
                yield from of_lot(place, lot, id_, h)

    def of_lot(place: int, lot: list[str], id_: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw, at, tokens, sizes = kind.cut(lot)
        size = np.asarray(sizes, np.int64)
        begin = np.concatenate([[0], np.cumsum(size + (1 if kind.gap else 0))])[:-1]
        total = len(at) - 1
        if total < w or size.max() < w:
            return
        inside = np.zeros(total + 2, np.int64)  # windows from a text's begin to its last
        long = size >= w
        np.add.at(inside, begin[long], 1)
        np.add.at(inside, (begin + size - w + 1)[long], -1)
        start, end, c0, c1 = kind.anchors(raw, tokens, np.cumsum(inside)[: total - w + 1] > 0)
        c1 = c1 + w
        around = kind.spans(raw, at, c0, c1)
        ah, ch = kind.names(kind.spans(raw, at, start, end), 2 * seed), kind.names(around, 2 * seed + 1)
        doc = np.searchsorted(begin, start, "right") - 1
        n, o, size_of, c0 = c1 - c0, start - c0, end - start, c0 - begin[doc]
        rows, places = once(doc, ah, ch, n, o, c0, around)
        more: list = [None] * len(rows)
        for i, others in places:
            more[i] = others
        cols = (ah[rows], ch[rows], id_[place + doc[rows]], h[place + doc[rows]], *(c[rows].astype(np.int32) for c in (c0, n, o, size_of)))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(more, pa.list_(pa.int32()))], ["ah", "ch", "id", "h", "c0", "n", "o", "l", "more"])

    return rows.select("id", "h", "text").mapInArrow(lean(run), ANCHORS)


def digits(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(big-endian 64-bit digit at every place, places a digit covers)."""
    if data.dtype != np.uint8:
        return data, 1
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:], 8


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in `at`, number of their group) of the windows data[at : at + window] that equal another of their first group.

    Most-significant digits first, through the window and no further; what is alone after a pass goes. A digit
    is a fifth of the window, named by hash; what comes out is compared token by token, and should names ever
    have misled, the passes are made over again with the tokens themselves.
    """
    p = prefix(data.astype(np.uint64, copy=False))
    wide = -(-window // 5)
    kept, number = _passes(at, group, [(lambda x, d=d: span_hash(p, x + d, x + min(d + wide, window))) for d in range(0, window, wide)])
    if len(kept):
        head = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
        lead = np.repeat(kept[head], np.diff(np.concatenate([head, [len(kept)]])))
        digit, size = digits(data)
        steps = [min(d, max(0, window - size)) for d in range(0, window, size)]
        same = group[kept] == group[lead]
        for d in steps if window >= size else []:
            same &= digit[at[kept] + d] == digit[at[lead] + d]
        if window < size or not same.all():
            return _passes(at, group, [(lambda x, d=d: data[x + d].astype(np.uint64)) for d in range(window)])
    return kept, number


def _passes(at: np.ndarray, group: np.ndarray, named: list) -> tuple[np.ndarray, np.ndarray]:
    kept, group = np.arange(len(at)), group.astype(np.uint64)
    for digit in named:
        value = mix(digit(at[kept]) + mix(group + _STEP))
        order = np.argsort(value)
        kept, value = kept[order], value[order]
        new = np.ones(len(kept), bool)
        new[1:] = value[1:] != value[:-1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        kept, group = kept[~alone], (np.cumsum(new) - 1).astype(np.uint64)[~alone]
        if not len(kept):
            break
    return kept, group.astype(np.int64)


def resolve(ah: np.ndarray, doc: np.ndarray, c0: np.ndarray, o: np.ndarray, size: np.ndarray, data: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) runs of window starts of contexts, given end to end in data, that repeat within an anchor.

    o is the anchor's place in its context: equal windows hold an equal anchor at the same distance.
    """
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = size - kind.window + 1
    own = np.repeat(np.arange(len(ah)), count)
    j = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    group = mix(np.unique(ah, return_inverse=True)[1][own].astype(np.uint64) * np.uint64(2**32) + (o[own] - j + 2**20).astype(np.uint64))
    kept, group = equal_windows(data, base[own] + j, group, kind.window)
    if not len(kept):
        return (np.empty(0, np.int64),) * 3
    # Contexts overlap, so a window may be there twice: places in the documents count.
    place = np.unique(doc, return_inverse=True)[1][own[kept]] * np.int64(2**32) + c0[own[kept]] + j[kept]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    low = np.minimum.reduceat(place, cuts)
    sizes = np.diff(np.concatenate([cuts, [len(group)]]))
    hit = place > np.repeat(low, sizes) if kind.later else np.repeat(low < np.maximum.reduceat(place, cuts), sizes)
    return runs(own[kept[hit]], j[kept[hit]])


def runs(own: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(own):
        return (np.empty(0, np.int64),) * 3
    order = np.lexsort((j, own))
    own, j = own[order], j[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (j[1:] > j[:-1] + 1)
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(own) - 1]])
    return own[first], j[first], j[last]


def repeated(docs: DataFrame, kind: Kind, unique: bool, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(id, h, spans array<struct<a, b>>): inclusive runs of window starts that repeat, for documents that have any."""
    rows = keyed(docs, id_col, text_col, unique)
    for seed in range(TRIES):
        spans = _attempt(rows, kind, held, seed)
        if spans is not None:
            return spans
    raise RuntimeError(f"equal hashes of different texts under each of {TRIES} seeds")


RUN = "struct<a: int, b: int, sid: long, sh: long, sa: int>"
#: What a document is asked for: n tokens from c0 on, for an anchor's context or for a run (sid, sh, sa).
ASKED = ("ah", "c0", "n", "o", "l", "contexts", "sid", "sh", "sa")
CUTS = "ah long, id long, h long, c0 int, n int, o int, l int, contexts long, sid long, sh long, sa int, data binary"


def _attempt(rows: DataFrame, kind: Kind, held: int, seed: int) -> DataFrame | None:
    """The spans, or None if some run differs from what it should repeat."""
    spark, w, passing = rows.sparkSession, kind.window, []
    path = fresh_path(spark, "anchors")
    anchors(rows, kind, seed).write.parquet(path)
    found = spark.read.schema(ANCHORS).parquet(path)
    times = F.coalesce(F.array_size("more"), F.lit(0)) + 1
    twice = written(found.groupBy("ah").agg(F.sum(times).alias("k")).where("k > 1"), "twice", passing)
    near = written(spread_join(found, twice, ["ah"], "k", ["id", "c0"]).drop("k"), "occurrences", passing)
    remove(spark, path)
    release(spark)

    # Contexts: how often each occurs, and its first and last occurrence in (document, place) order.
    shape = ["ah", "ch", "n", "o", "l"]
    last = F.max(F.struct("id", "h", F.greatest("c0", F.coalesce(F.array_max("more"), F.lit(0))).alias("c0")))
    contexts = written(near.groupBy(*shape).agg(F.sum(times).alias("k"), F.min(F.struct("id", "h", "c0")).alias("first"), last.alias("last")), "contexts", passing)

    # All occurrences of a context that occurs twice repeat whole; where order counts, all but the first. Those that a
    # document has besides its first are settled there, and where order doesn't count they settle the first one too.
    at = lambda a: F.struct(a.alias("a"), (a + F.col("n") - w).alias("b"))
    inner = F.transform("more" if kind.later else F.concat("more", F.array("c0")), at)
    inner = near.where("more is not null").select("id", "h", inner.alias("spans"))
    again = spread_join(near, contexts.where("k > 1"), shape, "k", ["id", "h", "c0"])
    is_first = (F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("c0") == F.col("first.c0"))
    source = F.col("first") if kind.later else F.when(is_first, F.col("last")).otherwise(F.col("first"))
    pieces = again.where(~is_first) if kind.later else again.where("more is null")
    piece = F.struct(F.col("c0").alias("a"), (F.col("c0") + F.col("n") - w).alias("b"), source["id"].alias("sid"), source["h"].alias("sh"), source["c0"].alias("sa"))
    runs = written(pieces.select("id", "h", piece.alias("p")).groupBy("id", "h").agg(F.collect_list("p").alias("p")).mapInArrow(lean(merge), f"id long, h long, runs array<{RUN}>"), "runs", passing)
    release(spark)

    # One occurrence of each context of an anchor that has several, and both ends of every run, are cut out of the texts.
    several = written(contexts.groupBy("ah").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several", passing)
    none = F.lit(None)
    wanted = spread_join(contexts, several, ["ah"], "contexts", ["ch"]).select("first.id", "first.h", F.struct("ah", "first.c0", "n", "o", "l", "contexts", none.cast("long").alias("sid"), none.cast("long").alias("sh"), none.cast("int").alias("sa")).alias("want"))
    # Runs are compared by pieces, parted at the same places of the document that they repeat, so equal ones come together early.
    ends = runs.select("id", "h", F.inline("runs")).withColumn("z", F.col("sa") + F.col("b") - F.col("a") + w)
    ends = ends.withColumn("g", F.explode(F.sequence(F.floor(F.col("sa") / PIECE), F.floor((F.col("z") - 1) / PIECE))))
    from_ = F.greatest("sa", F.col("g") * PIECE)
    ends = ends.select("id", "h", (F.col("a") + from_ - F.col("sa")).cast("int").alias("a"), "sid", "sh", from_.cast("int").alias("sa"), (F.least("z", (F.col("g") + 1) * PIECE) - from_).cast("int").alias("n"))
    ends = written(ends, "ends", passing)

    def side(id_: str, h: str, at: str) -> Column:
        key = (none.cast("long").alias("ah"), F.col(at).alias("c0"), F.col("n"), none.cast("int").alias("o"), none.cast("int").alias("l"), none.cast("long").alias("contexts"), F.col("sid"), F.col("sh"), F.col("sa"))
        return ends.select(F.col(id_).alias("id"), F.col(h).alias("h"), F.struct(*key).alias("want"))

    wanted = wanted.union(side("id", "h", "a")).union(side("sid", "sh", "sa").distinct())
    asked = wanted.groupBy("id", "h").agg(F.collect_list("want").alias("asked")).join(rows.select("id", "h", "text"), ["id", "h"])
    cuts = written(asked.select("id", "h", "asked", "text").mapInArrow(lean(cutting(kind)), CUTS), "cuts", passing)
    release(spark)

    slices = cuts.where("ah is null").groupBy("sid", "sh", "sa", "n").agg(F.min("data").alias("low"), F.max("data").alias("high"))
    if not slices.where("low <> high").isEmpty():
        for p in passing:
            remove(spark, p)
        return None
    spans = _ordered(cuts.where("ah is not null").select("ah", "id", "h", "c0", "o", "l", "contexts", "data"), kind, held, seed, passing)
    spans = spans.select("id", "h", F.array(F.struct("a", "b")).alias("spans"))
    spans = spans.union(inner).union(runs.select("id", "h", F.transform("runs", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))).alias("spans")))
    spans = written(spans.groupBy("id", "h").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    for p in passing:
        remove(spark, p)
    release(spark)
    return spans


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, pieces) to (id, h, runs): pieces of a document that repeat another at the same distance and meet are one run."""
    for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
        a, z, sid, sh, sa = (c.to_numpy().astype(np.int64) for c in b.column(2).flatten().flatten())
        order = np.lexsort((a, sa - a, sh, sid, row))
        row, a, z, sid, sh, sa = (x[order] for x in (row, a, z, sid, sh, sa))
        new = np.ones(len(row), bool)
        for x in (row, sid, sh, sa - a):
            new[1:] &= x[1:] == x[:-1]
        # The farthest end so far of a group, which starts anew with each: ends are lifted by the group's number.
        group = np.cumsum(~new | (np.arange(len(new)) == 0))
        reach = np.maximum.accumulate(z + group * 2**32) - group * 2**32
        new[1:] &= a[1:] <= reach[:-1] + 1
        first = np.flatnonzero(~new | (np.arange(len(new)) == 0))
        end = reach[np.concatenate([first[1:], [len(row)]]) - 1]
        cols = (a[first], end, sid[first], sh[first], sa[first])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        found = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "sid", "sh", "sa"])
        ends = np.searchsorted(row[first], np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), found)], ["id", "h", "runs"])


def cutting(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, h, asked, text) to a row for every part that the documents are asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for id_, h, want, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw, at, _, _ = kind.cut([x.as_py()])
                got = want.values.flatten()
                c0, n = (got[ASKED.index(c)].to_numpy().astype(np.int64) for c in ("c0", "n"))
                data = pa.array(kind.spans(raw, at, c0, c0 + n), pa.binary())
                m = len(c0)
                col = dict(zip(ASKED, got, strict=True)) | {"id": pa.array([id_] * m, pa.int64()), "h": pa.array([h] * m, pa.int64()), "data": data}
                names = ["ah", "id", "h", "c0", "n", "o", "l", "contexts", "sid", "sh", "sa", "data"]
                yield pa.RecordBatch.from_arrays([col[c] for c in names], names)

    return cut


CONTEXT = "ah long, id long, h long, c0 int, o int, l int, data binary"


def _ordered(cuts: DataFrame, kind: Kind, held: int, seed: int, passing: list[str]) -> DataFrame:
    """(id, h, a, b): runs of windows that repeat among the contexts of each anchor."""
    spans: list[DataFrame] = []
    few, hot = cuts.where(F.col("contexts") <= held), cuts.where(F.col("contexts") > held)
    while not hot.isEmpty():
        spans.append(_spelled(hot.where(F.col("l") == kind.window), kind, passing))
        parted = written(hot.where(F.col("l") < kind.window).drop("contexts").mapInArrow(lean(longer(kind, seed)), CONTEXT), "parted", passing)
        sizes = parted.groupBy("ah").agg(F.count("*").alias("contexts")).where("contexts > 1")
        parted = written(spread_join(parted, written(sizes, "sizes", passing), ["ah"], "contexts", ["id", "c0"]), "parted", passing)
        few, hot = few.unionByName(parted.where(F.col("contexts") <= held)), parted.where(F.col("contexts") > held)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from order(batches, kind)

    out = few.select("ah", "id", "h", "c0", "o", "data").repartition("ah").sortWithinPartitions("ah").mapInArrow(lean(ordered), "id long, h long, a int, b int")
    for s in spans:
        out = out.union(s)
    return out


def longer(kind: Kind, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each context under two longer anchors, with half of what its window lacks on the left, and on the right."""
    w = kind.window

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            out = []
            for ah, id_, h, c0, o, size, data in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                raw, at = data, offsets(data, kind)
                n, half = len(at) - 1, (w - size + 1) // 2
                for mark, start, a in ((b"<", o - half, o - half), (b">", o, o + size)):
                    end = start + size + half
                    if start < 0 or end > n:
                        continue
                    digit = raw[at[a] : at[a + half] - kind.gap]
                    key = xxhash.xxh64_intdigest(ah.to_bytes(8, "little", signed=True) + mark + digit, 2 * seed)
                    lo, hi = max(0, end - w), min(n, start + w)
                    out.append((key - 2**64 if key >= 2**63 else key, id_, h, c0 + lo, start - lo, size + half, raw[at[lo] : at[hi] - kind.gap]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["ah", "id", "h", "c0", "o", "l", "data"])

    return part


def offsets(data: bytes, kind: Kind) -> list[int]:
    """Begin of every token of a span's bytes, and what follows the last one."""
    if not kind.gap:
        return list(range(len(data) + 1))
    out, at = [0], -1
    while (at := data.find(b" ", at + 1)) >= 0:
        out.append(at + 1)
    return [*out, len(data) + 1]


def _spelled(whole: DataFrame, kind: Kind, passing: list[str]) -> DataFrame:
    """Anchors that spell the window: equal bytes are equal windows."""
    place = F.struct("id", "h", (F.col("c0") + F.col("o")).alias("a"))
    rows = whole.select("data", place.alias("p"))
    met = rows.groupBy("data").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("k")).where("low <> high")
    found = spread_join(rows, written(met, "spelled", passing), ["data"], "k", ["p"])
    if kind.later:
        found = found.where(F.col("p") > F.col("low"))
    return found.select("p.id", "p.h", F.col("p.a").alias("a"), F.col("p.a").alias("b"))


def order(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """(ah, id, h, c0, o, data) in order of ah to runs of windows that repeat, lots of anchors at a time."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        size += b.column(5).nbytes
        if size > 2 * AT_ONCE:
            whole = pa.Table.from_batches(kept).combine_chunks()
            a = whole.column(0).to_numpy()
            last = int(np.searchsorted(a, a[-1]))
            if last:
                yield from solve(whole.slice(0, last), kind)
                whole = whole.slice(last)
            kept, size = whole.to_batches(), sum(x.column(5).nbytes for x in whole.to_batches()) if last else 0
    if kept:
        yield from solve(pa.Table.from_batches(kept), kind)


def solve(t: pa.Table, kind: Kind) -> Iterator[pa.RecordBatch]:
    ah, id_, h, c0, o = (t.column(i).to_numpy().astype(np.int64) for i in range(5))
    n = pc.binary_length(t.column(5)).to_numpy()
    first = np.ones(len(ah), bool)
    order = np.lexsort((n, o, c0, h, id_, ah))
    ah, id_, h, c0, o, n = (x[order] for x in (ah, id_, h, c0, o, n))
    for x in (ah, id_, h, c0, o, n):
        first[1:] &= x[1:] == x[:-1]
    first[1:] = ~first[1:]
    order = order[first]  # a document that is there in several equal rows gave its contexts several times
    ah, id_, h, c0, o = (x[first] for x in (ah, id_, h, c0, o))
    raw = t.column(5).take(pa.array(order)).to_pylist()
    doc = np.unique(np.stack([id_, h], 1), axis=0, return_inverse=True)[1].reshape(-1)
    # Anchors are ordered in lots of bounded size; one anchor is never parted.
    ends = np.concatenate([np.flatnonzero(np.diff(ah)) + 1, [len(ah)]])
    start, load = 0, np.cumsum([len(r) for r in raw])
    for k, e in enumerate(ends.tolist()):
        ahead = ends[k + 1] if k + 1 < len(ends) else e
        if k + 1 == len(ends) or load[ahead - 1] - (load[start - 1] if start else 0) > 2 * AT_ONCE:
            s = slice(start, e)
            data, size = kind.values(raw[start:e])
            own, a, z = resolve(ah[s], doc[s], c0[s], o[s], size, data, kind)
            if len(own):
                own += start
                yield pa.RecordBatch.from_arrays([pa.array(id_[own]), pa.array(h[own]), pa.array((c0[own] + a).astype(np.int32)), pa.array((c0[own] + z).astype(np.int32))], ["id", "h", "a", "b"])
            start = e


def covered(spans: list, window: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of tokens that the windows starting in the spans cover."""
    out: list[list[int]] = []
    for s in sorted((r["a"], r["b"]) for r in spans):
        a, b = s[0], min(s[1] + window, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, kind: Kind, id_col: str, text_col: str, held: int = HELD) -> DataFrame:
    """(doc_id, text, spans): every document with what repeats in it."""
    unique = unique_ids(docs, id_col)
    spans = repeated(docs, kind, unique, id_col, text_col, held)
    return keyed(docs, id_col, text_col, unique).join(spans, ["id", "h"], "left").select("doc_id", "text", "spans")
