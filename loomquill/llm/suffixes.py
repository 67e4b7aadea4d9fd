"""Suffix-array dedup of bytes: strings of 200 bytes that start at two places or more are removed wherever they are.

The suffix order is made through the threshold's bytes only, and only for suffixes that can repeat: see
`repeats`. A window's anchor is its 64-byte string of least hash, the leftmost of equal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean
from .repeats import HELD, Kind, chosen, covered, least, prefix, span_hash, with_spans


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, list[bytes], list[int]]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"".join(parts)
    return raw, np.arange(len(raw) + 1), [], list(map(len, parts))


def values(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(spans), np.uint8), np.fromiter(map(len, spans), np.int64, len(spans))


def kind(window: int = 200, bits: int = 64) -> Kind:
    size = max(1, window * 64 // 200)

    def anchors(raw: bytes, _: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = prefix(np.frombuffer(raw, np.uint8).astype(np.uint64))
        start = np.arange(len(raw) - size + 1)
        place = least(span_hash(p, start, start + size), window - size + 1)
        windows = np.flatnonzero(inside)
        found, first, last = chosen(place[windows], windows)
        return found, found + size, first, last

    return Kind(window, cut, anchors, values, gap=0, later=False, bits=bits)


def repeated_bytes(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, removed array<struct<start,end>>) of every document.

    A byte goes if a string of `window` bytes that covers it also starts elsewhere, in the same document or
    another; null texts are empty; a text under `window` bytes stays whole. Rows that repeat under the same id
    are documents of their own, so each loses what a window covers. A null id is kept. An empty table gives no rows.
    """
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start int, end int>>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                s = b.slice(at, 1024)
                rows = []
                for x, found in zip(s.column(1), s.column(2).to_pylist(), strict=True):
                    raw = x.as_py().encode("utf-8", "surrogatepass")
                    gone = covered(found or [], window, len(raw))
                    ends = [0, *(e for _, e in gone)]
                    kept = b"".join(raw[a:z] for a, z in zip(ends, [*(a for a, _ in gone), len(raw)], strict=True))
                    rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": z} for a, z in gone]))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(span))
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    return with_spans(docs, kind(window, bits), id_col, text_col, held).mapInArrow(lean(run), out)
