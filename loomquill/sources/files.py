"""Files: transcripts, graphs, listings. Names and sizes come with the scan, so filters on them are made before texts are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a session file's header names its session, volume and date; several sessions are parted by commas.
HEADER = {"session": "\\*\\*Sessions?:\\*\\*\\s*([0-9][0-9, ]*)", "volume": "\\*\\*Volume:\\*\\*\\s*(\\d+)", "date": "\\((\\d{1,2}\\s+[\\p{L}\\p{N}_]+\\s+\\d{4})\\)"}
NODE = "struct<id: string, type: string, name: string, sessions: array<int>, mentions: long>"
EDGE = "struct<id: string, source: string, target: string, type: string, weight: long>"


def text_files(spark: SparkSession, path: str | list[str], glob: str = "[0-9]*.md", least: int = 0) -> DataFrame:
    """(path, folder, name, size, text) of the files below a path whose names fit and that have at least so many bytes.

    Order is by (folder, name) where a caller needs it. Each file is one row, so a file must fit a task; empty files give none.
    """
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    p = F.col("_metadata.file_path")
    rows = rows.where(F.col("_metadata.file_size") >= least) if least else rows
    return rows.select(p.alias("path"), F.try_element_at(F.split(p, "/"), F.lit(-2)).alias("folder"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def with_header(files: DataFrame, strict: bool = False, text: str = "text") -> DataFrame:
    """files with sessions (array), volume and date from the header; missing parts are null.

    A header that names several sessions gives them all; strict leaves such files out, as a reader of one number would.
    """
    value = lambda k: F.nullif(F.regexp_extract(text, HEADER[k], 1), F.lit(""))
    sessions = F.transform(F.split(F.trim(value("session")), "\\s*,\\s*"), lambda x: x.try_cast("int"))
    out = files.withColumns({"sessions": F.filter(sessions, lambda x: x.isNotNull()), "volume": value("volume").cast("int"), "date": value("date")})
    return out.where(F.size("sessions") == 1) if strict else out


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files, by a fixed schema; nodes may be called entities. Unknown fields are left out."""
    rows = spark.read.schema(f"nodes array<{NODE}>, entities array<{NODE}>, edges array<{EDGE}>").json(path, multiLine=True)
    return rows.select(F.inline(F.coalesce("nodes", "entities"))), rows.select(F.inline("edges"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of some paths that is there, on whatever file system it names."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    return None


def listing(spark: SparkSession, path: str, descriptions: list[tuple[str, str]], otherwise: str = "Other", glob: str = "*.txt") -> DataFrame:
    """(name, size, modified, description) of files that aren't empty, no text read; the first prefix that a name has describes it."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    return rows.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), described(name, descriptions, otherwise).alias("description"))


def described(name: Column, descriptions: list[tuple[str, str]], otherwise: str) -> Column:
    return reduce(lambda out, p: F.when(F.startswith(F.lower(name), F.lit(p[0].lower())), p[1]).otherwise(out), reversed(descriptions), F.lit(otherwise))


def one_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(name, size, n_lines, text) of one file of a folder; a name that leads out of the folder is an error."""
    if not name or "/" in name or "\\" in name or name.startswith("."):
        raise ValueError(f"not a plain file name: {name!r}")
    rows = spark.read.text(f"{folder.rstrip('/')}/{name}", wholetext=True)
    return rows.select(F.lit(name).alias("name"), F.col("_metadata.file_size").alias("size"), F.size(F.split("value", "\n")).alias("n_lines"), F.col("value").alias("text"))


def attributes(name: Column, kinds: dict[str, str] | None = None) -> list[Column]:
    """(kind, volume, band, first, last) of a file's name.

    vol<v>_summary, vol<v>_band<b> of volumes 5 and 6, and vol<v>_p<digits>, whose digits name a range of sessions by how many they are: up
    to two are the last one from 1; three the first by one digit; four by two and two; five by two and two, the fifth unused; six by three and three.
    """
    base = F.regexp_replace(name, "\\.[a-zA-Z]+$", "")
    number = lambda p, k=1: F.nullif(F.regexp_extract(base, "(?i)" + p, k), F.lit("")).try_cast("int")
    summary, band, digits = F.contains(base, F.lit("_summary")), base.rlike("(?i)vol[56]_band"), F.nullif(F.regexp_extract(base, "(?i)vol[0-9]+_p([0-9]+)", 1), F.lit(""))
    n = F.length(digits)
    part = lambda a, k: F.substring(digits, a, k).try_cast("int")
    ranged = ~summary & ~band & digits.isNotNull()
    first = F.when(n <= 2, F.lit(1)).when(n == 3, part(1, 1)).when(n <= 5, part(1, 2)).when(n == 6, part(1, 3))
    last = F.when(n <= 2, digits.try_cast("int")).when(n == 3, part(2, 2)).when(n <= 5, part(3, 2)).when(n == 6, part(4, 3))
    other = F.lit("unknown")
    for key, kind in (kinds or {}).items():
        other = F.when(base == key, kind).otherwise(other)
    kind = F.when(summary, "summary").when(band, "statement").when(ranged, "sessions").otherwise(other)
    volume = F.when(summary | band | ranged, number("vol([0-9]+)"))
    return [kind.alias("kind"), volume.alias("volume"), F.when(band & ~summary, number("band([0-9]+)")).alias("band"), F.when(ranged, first).alias("first"), F.when(ranged, last).alias("last")]


def session_list(spark: SparkSession, path: str, by: str, order: str, *cells: str) -> DataFrame:
    """A table of comma-separated values whose blank cells take the value above them."""
    from ..operators.segment import blanks_inherit

    return blanks_inherit(spark.read.csv(path, header=True, multiLine=True), by, [order], *cells)


def or_stored(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path, made and written first if it isn't there: extraction that is done is not done again."""
    if first_existing(spark, [f"{path}/_SUCCESS"]) is None:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
