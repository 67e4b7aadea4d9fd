"""Writers: graphs, one file a testimony, indexes, and what has been sent where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name


def inputs(*frames: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}


def graph_json(nodes: DataFrame, edges: DataFrame, path: str, **metadata: str) -> None:
    """A folder with nodes, edges and a metadata row as JSON lines, replaced if there; never the folder that they are read from."""
    target = path.rstrip("/")
    if any(source.split(":", 1)[-1].lstrip("/").startswith(target.split(":", 1)[-1].lstrip("/")) for source in inputs(nodes, edges)):
        raise ValueError("a graph isn't written over what it is read from")
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    for name, rows in (("nodes", nodes), ("edges", edges), ("metadata", counts.withColumns({k: F.lit(v) for k, v in metadata.items()}))):
        rows.write.mode("overwrite").json(f"{target}/{name}")


def testimony_text(name: Column, session: Column, text: Column) -> Column:
    return F.concat(F.lit("# Testimony of "), name, F.lit("\n\n**Session:** "), F.coalesce(session.cast("string"), F.lit("")), F.lit("\n\n---\n\n"), text, F.lit("\n"))


def testimony_files(rows: DataFrame, path: str, name: str, session: str, text: str) -> None:
    """One folder a testimony, named after its witness, with a text file in it; all testimonies of one name go there.

    Tasks write their own files, so nothing is brought together; a row's text is one file's.
    """
    out = rows.select(file_name(F.col(name)).alias("file"), testimony_text(F.col(name), F.col(session), F.col(text)).alias("value"))
    out.repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def index(rows: DataFrame, name: str, status: str, failed: str = "failed") -> DataFrame:
    """(total, done, failed, failures): counts of an outcome table and the sorted names of what failed, in one row."""
    bad = F.col(status) == failed
    return rows.agg(F.count("*").alias("total"), F.count(F.when(~bad, 1)).alias("done"), F.count(F.when(bad, 1)).alias("failed"), F.array_sort(F.collect_set(F.when(bad, F.col(name)))).alias("failures"))


def two_forms(rows: DataFrame, light: list[str], counted: str) -> tuple[DataFrame, DataFrame]:
    """(the whole index, its light form: some columns, and how many the counted array has)."""
    return rows, rows.select(*light, F.size(F.coalesce(counted, F.array().cast(rows.schema[counted].dataType))).alias(f"n_{counted}"))


def sent(files: DataFrame, manifest: DataFrame, name: str = "name") -> DataFrame:
    """files with `outcome`: skipped if the manifest has the name, else uploaded, the first of a name; others of it are skipped."""
    w = Window.partitionBy(name).orderBy(*[c for c in files.columns if c != name] or [name])
    known = manifest.select(F.col(name).alias("_k")).distinct().withColumn("_there", F.lit(True))
    marked = files.withColumn("_r", F.row_number().over(w)).join(known, F.col(name) == F.col("_k"), "left")
    return marked.withColumn("outcome", F.when(F.col("_there") | (F.col("_r") > 1), "skipped").otherwise("uploaded")).select(*files.columns, "outcome")


def upsert(manifest: DataFrame, outcomes: DataFrame, name: str = "name") -> DataFrame:
    """The manifest with what was uploaded in place of its rows, and what was skipped where it has none."""
    new = outcomes.withColumn("_p", F.when(F.col("outcome") == "uploaded", 0).otherwise(2)).drop("outcome")
    both = new.unionByName(manifest.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (name, "_p")]
    return both.groupBy(name).agg(F.min_by(F.struct(*fields), "_p").alias("_x")).select(name, "_x.*")
