"""Byte-level BPE by a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair of tokens of which the left one starts at byte i, the root
the least rank and, among equals, the leftmost place. A merge changes at most three leaves, each in
logarithmic time, so a run of n bytes without a break costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, texts

#: Entries of each worker's memories of encoded chunks and of pieces; each is emptied when full.
MEMO = 500_000
PIECES = 800_000

_BREAK = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s ")
_LOOSE_ASCII = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
_loaded: dict[tuple[str, str], Codec] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of least rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    size = 1
    while size < n - 1:
        size *= 2
    none = len(ranks) * n + n << 1
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    while (top := tree[1]) < none:
        i = top % n
        j = end[i]
        k = end[i] = end[j]
        p = before[i]
        # The pair at i now starts with the merged token, the one at j is gone, the one before ends with it.
        if k < n:
            before[k] = i
            r = get(piece[i : end[k]])
            changed = [(i, none if r is None else r * n + i), (j, none)]
        else:
            changed = [(i, none)]
        if p >= 0:
            r = get(piece[p:k])
            changed.append((p, none if r is None else r * n + p))
        for at, value in changed:
            at += size
            while tree[at] != value:
                tree[at] = value
                if at == 1:
                    break
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder over a rank file. Chunks that start with a single blank are remembered without it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo: dict[str, str] = {}  # ids written out, by chunk
        self.pieces: dict[str, str] = {}

    def chunk_ids(self, chunk: str) -> str:
        out, pieces = [], self.pieces
        for m in self.pattern.findall(chunk):
            ids = pieces.get(m)
            if ids is None:
                ids = " ".join(map(str, merge_ids(m.encode("utf-8", "surrogatepass"), self.ranks)))
                if len(m) <= 64:
                    if len(pieces) >= PIECES:
                        pieces.clear()
                    pieces[m] = ids
            out.append(ids)
        return " ".join(out)

    def chunks(self, text: str) -> tuple[str, list[str]]:
        """The first chunk and the others less their leading blank: cuts lie between a character that isn't
        white space and a blank, where every match ends anyway."""
        if any(x in text for x in _LOOSE_ASCII) or not text.isascii() and _LOOSE.search(text):
            first, *rest = _BREAK.split(text)
            return first, [x[1:] for x in rest]
        rest = text.split(" ")
        first = rest.pop(0)
        return first, rest

    def written(self, text: str) -> list[str]:
        """The ids of each chunk as decimals parted by blanks, without empty chunks."""
        memo = self.memo
        first, rest = self.chunks(text)
        new = set(rest).difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set(rest)
        for c in new:
            memo[c] = self.chunk_ids(" " + c)
        out = list(map(memo.__getitem__, rest))
        return [self.chunk_ids(first), *out] if first else out

    def encode(self, text: str) -> list[int]:
        return list(map(int, " ".join(self.written(text)).split()))

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document.

    Null and empty texts have no ids; rows that repeat are each encoded; a null doc_id is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                ids = pa.array((c.encode(x) for x in s.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([s.column(0), ids], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((c.decode(x or ()) for x in b.column(1).to_pylist()), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, its ids are decoded, digests kept.

    Null and empty texts give no tokens and the digests of nothing; a null doc_id is kept. Nothing is shuffled.
    """
    out = T.StructType().add("doc_id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        back: dict[str, bytes] = {}  # decoded, by the ids written out
        gc.disable()  # nothing here makes cycles, and walking the memories costs much
        try:
            for b in batches:
                n, ids_sha, text_sha = [], [], []
                for x in b.column(1):
                    shown = c.written(x.as_py())
                    try:
                        decoded = b"".join(map(back.__getitem__, shown))
                    except KeyError:
                        if len(back) > MEMO:
                            back.clear()
                        for s in set(shown).difference(back):
                            back[s] = c.decode(list(map(int, s.split())))
                        decoded = b"".join(map(back.__getitem__, shown))
                    ids = " ".join(shown)
                    n.append(ids.count(" ") + 1 if shown else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], out.names)
        finally:
            gc.enable()

    return texts(docs, id_col, text_col).mapInArrow(lean(run), out)
