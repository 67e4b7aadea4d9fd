"""Token-id files: flat unsigned integers and 64-bit offsets, one pair of files a partition.

Partition p of the id order writes `part-ppppp.ids` (little-endian uint16 or uint32), `part-ppppp.off`
(uint64, one more than documents, from 0 within the part) and `part-ppppp.doc` (int64 document ids). The
base of a part is the prefix sum of the parts before it, kept in `index.json`, so any document is found by
one addition and read through a memory map.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import lean, partitions, texts
from .words import word_encoder

#: Stands for a null document id in the .doc file.
NO_ID = -(2**63)


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def put(path: str, pieces: Iterator[bytes]) -> None:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}"
    if (at := _local(own)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.writelines(pieces)
        os.replace(at, _local(path))
        return
    store, at = _store(own)
    with store.open_output_stream(at) as f:
        for p in pieces:
            f.write(p)
    store.move(at, _store(path)[1])


def view(path: str, dtype: str) -> np.ndarray:
    """The file as an array: a memory map where the folder is mounted, else one read."""
    if (at := _local(path)) is not None:
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.empty(0, dtype)
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> dict:
    """Write all documents in ascending doc_id order (null first, ties by text); returns the index.

    Null and empty texts hold the end id alone. An empty table gives empty parts. Ids that a part's buffer
    holds go to the file as they come, so memory doesn't grow with the part.
    """
    spark = docs.sparkSession
    vocabulary = word_encoder(tokenizer_path).tokenizer.get_vocab_size()
    dtype = "<u2" if max(vocabulary - 1, end_id) < 2**16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, tail = word_encoder(tokenizer_path), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        base, sizes, ids = f"{path}/part-{part:05d}", [], []

        def encoded() -> Iterator[bytes]:
            for b in batches:
                ids.extend(NO_ID if x is None else x for x in b.column(0).to_pylist())
                for x in w.encode_all(x.as_py() for x in b.column(1)):
                    raw = np.frombuffer(x + tail, "<u4")
                    sizes.append(len(raw))
                    yield raw.astype(dtype).tobytes()

        put(f"{base}.ids", encoded())
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype("<u8")
        put(f"{base}.off", iter([offsets.tobytes()]))
        put(f"{base}.doc", iter([np.asarray(ids, "<i8").tobytes()]))
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})

    ordered = texts(docs, id_col, text_col).repartitionByRange(parts or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    # One row a partition comes back, never one a document.
    rows = sorted(ordered.mapInArrow(lean(run, keeps=True), "part long, n_docs long, n_tokens long").collect())
    index, base = {"dtype": dtype, "end_id": end_id, "parts": []}, 0
    for r in rows:
        index["parts"].append({"part": r.part, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": base})
        base += r.n_tokens
    put(f"{path}/index.json", iter([json.dumps(index).encode()]))
    return index


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids, end id included, and the number of ids before it."""
    return _scan(spark, path, lambda a, o, i: pa.array(a[o[i] : o[i + 1]].astype("<i8"), pa.int64()), "ids array<long>", pa.list_(pa.int64()))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, base, ids, off, docs in _parts(batches, path):
            for at in range(0, len(docs), 10_000):
                o = off[at : at + 10_001].astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_ids(docs[at : at + 10_000]), pa.array(base + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _part_rows(spark, path).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _index(path: str) -> dict:
    return json.loads(view(f"{path}/index.json", "u1").tobytes())


def _part_rows(spark: SparkSession, path: str) -> DataFrame:
    n = max(1, len(_index(path)["parts"]))
    return spark.range(0, n, 1, n)


def _ids(docs: np.ndarray) -> pa.Array:
    return pa.array(docs, pa.int64(), mask=docs == NO_ID)


def _parts(batches: Iterator[pa.RecordBatch], path: str):
    index = _index(path)
    for b in batches:
        for i in b.column(0).to_pylist():
            if i < len(index["parts"]):
                p = index["parts"][i]
                name = f"{path}/part-{p['part']:05d}"
                yield p["part"], p["base"], view(f"{name}.ids", index["dtype"]), view(f"{name}.off", "<u8"), np.asarray(view(f"{name}.doc", "<i8"))


def _scan(spark: SparkSession, path: str, one, column: str, kind: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, base, ids, off, docs in _parts(batches, path):
            for at in range(0, len(docs), 512):
                o = off[at : at + 513].astype(np.int64)
                rows = pa.array([ids[a:b].astype("<i8") for a, b in zip(o[:-1], o[1:], strict=True)], kind)
                yield pa.RecordBatch.from_arrays([_ids(docs[at : at + 512]), pa.array(base + o[:-1]), rows], ["doc_id", "start", column.split()[0]])

    return _part_rows(spark, path).mapInArrow(lean(run), f"doc_id long, start long, {column}")
