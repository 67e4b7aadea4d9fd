"""Shared plumbing: written intermediate tables, counted partitions, the JVM's file system."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows that any operator here sends to all executors at once. Beyond it a shuffle join is taken.
BROADCAST_ROWS = 200_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomquill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have stopped already
            continue


def written(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a read only.

    Its path is added to passing, for tables that the caller removes before the driver ends.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    if passing is not None:
        passing.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """What runs meanwhile sends Python so many rows at once, at most: buffers of texts on both sides grow with that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: they go when their handles are collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def trimmed() -> Iterator[None]:
    """Give a worker's freed memory back to the system when its task ends: workers live on."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Functions that empty what this process keeps from one task to the next.
kept: list[Callable[[], None]] = []


def forget() -> None:
    for empty in kept:
        empty()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function on batches, with the worker's memory given back at its end.

    Workers live on, and tasks of another kind come to them: what earlier ones kept goes first, unless this kind uses it.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        with trimmed():
            yield from run(batches)

    return wrapped


#: Keys of more rows than this, and than one in ten thousand of all, are dealt out in a join.
CROWD = 2_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], times: str, by: list[str]) -> DataFrame:
    """left joined to right, which has each key once and how many rows of left have it (about) in `times`.

    The rows of very frequent keys are dealt out by the columns `by`, and right's row is repeated for each deal, so
    no task gets all rows of a key. Fewer than 10,000 keys can be that frequent, so these alone are broadcast.
    """
    total = right.agg(F.sum(times)).first()[0] or 0
    limit = max(CROWD, total // 10_000)
    hot = right.where(F.col(times) > limit).select(*on, F.ceil(F.col(times) / limit).cast("int").alias("_deals"))
    if hot.isEmpty():
        return left.join(right, on)
    hot, deals = F.broadcast(hot), F.coalesce("_deals", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_deal", F.pmod(F.xxhash64(*by), deals).cast("int")).drop("_deals")
    each = right.join(hot, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return dealt.join(each, [*on, "_deal"]).drop("_deal")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string not null): other columns go, so that none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
