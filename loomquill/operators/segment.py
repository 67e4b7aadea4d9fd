"""Lines, chunks, sessions and spans: the operators that follow an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def fixed_chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, start, chunk): slices of so many characters; the last may be shorter. Nothing is capped."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return docs.select(key, text, F.posexplode(at).alias("chunk_id", "start")).select(key, "chunk_id", "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def line_batches(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, batch, n_lines, text): every `size` lines joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(key, F.floor(F.col("line_no") / size).alias("batch")).agg(F.count("*").alias("n_lines"), F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("text"))


def packed_chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, line_start, line_end, n_chars): lines are added until the chunk has `size` characters or more."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chunk, start, n = 0, 0, 0
                parts = (t or "").split("\n")
                for i, line in enumerate(parts):
                    n += len(line) + (i > start)
                    if n >= size or i == len(parts) - 1:
                        rows.append((k, chunk, start, i, n))
                        chunk, start, n = chunk + 1, i + 1, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.int32()] * 3, pa.int64()), strict=True)], [key, "chunk_id", "line_start", "line_end", "n_chars"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, chunk_id int, line_start int, line_end int, n_chars long")


def carry_forward(rows: DataFrame, by: str, order: list[str], marker: Column, name: str) -> DataFrame:
    """The last marker seen, null before the first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def intervals(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, island, value, start, end, n): an interval begins where the value changes and ends before the next."""
    w = Window.partitionBy(by).orderBy(*order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", changed).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(by, "island", value).agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("n"))


def longest_per_value(found: DataFrame, by: str, value: str) -> DataFrame:
    w = Window.partitionBy(by, value).orderBy(F.desc("n"), "start", "island")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_per_value(found: DataFrame, by: str, value: str) -> DataFrame:
    w = Window.partitionBy(by, value).orderBy("island")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def spans_to_next(markers: DataFrame, by: str, at: str) -> DataFrame:
    """Each marker with the place of the next one, null at the end."""
    return markers.withColumn("next_at", F.lead(at).over(Window.partitionBy(by).orderBy(at)))


def paragraphs(rows: DataFrame, by: str, order: str, starts: Column, text: str) -> DataFrame:
    """(by, paragraph, n_rows, text): a row that starts one opens a paragraph, the others join it."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("paragraph", F.sum(starts.cast("int")).over(w))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return marked.groupBy(by, "paragraph").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(ordered, lambda x: x[text]), " ").alias("text"))


def best_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before it, by one union and one window."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(by, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("as_of_" + value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_v", "_side")


def column_order(blocks: DataFrame, midline: float = 306.0) -> DataFrame:
    """Reading order of right-to-left pages in two columns: page, right column first, then down."""
    w = Window.partitionBy("page").orderBy(F.when(F.col("x0") > midline, 0).otherwise(1), "y0", "x0")
    return blocks.withColumn("place", F.row_number().over(w))


def adaptive_column_order(blocks: DataFrame, order: str) -> DataFrame:
    """Reading order where the page tells its columns: x and y are shares of the page.

    A page whose blocks lie over 0.4 apart has two columns, parted amid its widest gap, or at 0.5 if none reaches 0.1;
    the right one comes first. Other pages go down. order settles ties. One window a page and one equi-join.
    """
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("page").orderBy("x"))
    widest = F.max_by(F.col("x") - F.col("gap") / 2, F.struct("gap", -F.col("x")))
    shape = blocks.select("page", "x").withColumn("gap", gap).groupBy("page").agg((F.max("x") - F.min("x") > 0.4).alias("_two"), F.when(F.max("gap") >= 0.1, widest).otherwise(0.5).alias("_edge"))
    side = F.when(F.col("_two") & (F.col("x") <= F.col("_edge")), 1).otherwise(0)
    w = Window.partitionBy("page").orderBy(side, "y", order)
    return blocks.join(shape, "page").withColumn("place", F.row_number().over(w)).drop("_two", "_edge")


def first_marker_near(docs: DataFrame, marker: str, names: list[str], ahead: int = 15, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no): the first line with the marker that has one of the names in it or in the lines ahead; others go. Nothing is shuffled."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    near = lambda p, i: F.array_join(F.slice(p, i + 1, ahead), "\n")
    named = lambda p, i: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(near(p, i), n))
    at = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.contains(F.get("_p", i), F.lit(marker)) & named(F.col("_p"), i))
    return docs.select(key, parts.alias("_p")).select(key, F.array_min(at).alias("line_no")).where("line_no is not null")


def blanks_inherit(rows: DataFrame, by: str, order: list[str], *cells: str) -> DataFrame:
    """Blank or null cells take the value above them in their list, null at its top."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.when(F.trim(F.col(c)) != "", F.col(c)), ignorenulls=True).over(w) for c in cells})


def sections(rows: DataFrame, heading: str, key: str = "doc_id") -> DataFrame:
    """(key, section, first_line, n_lines, text): a line with the heading's pattern opens a section; 0 is what stands before the first."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("section", F.sum(F.col("line").rlike(heading).cast("long")).over(w))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), " ")
    return marked.groupBy(key, "section").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n_lines"), joined.alias("text"))


def body_start(rows: DataFrame, found: Column, otherwise: int, key: str = "doc_id") -> DataFrame:
    """(key, body_start): the first line for which found holds, else a fixed place."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(found, F.col("line_no"))), F.lit(otherwise)).alias("body_start"))
