"""Rollups of mentions, sessions and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_prefix(rows: DataFrame, key: Column, size: int, count: str, name: str) -> DataFrame:
    """(key, mentions, n_names, name): rows whose key begins with the same characters are one; the longest name, the first of equals by text."""
    best = F.min_by(F.col(name), F.struct(-F.length(name), F.col(name)))
    return rows.groupBy(F.substring(key, 1, size).alias("key")).agg(F.sum(count).alias("mentions"), F.countDistinct(name).alias("n_names"), best.alias("name"))


def appearances(events: DataFrame, name: str, order: list[str], *fields: str) -> DataFrame:
    """(name, n, appearances): the events of each name in order, as structs. A name's list grows with its events."""
    return events.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("appearances"))


def merged_sessions(rows: DataFrame, key: str, testified: str, mentioned: str, count: str) -> DataFrame:
    """(key, mentions, sessions): partial results summed; sessions with testimony are preferred to those of mentions where there are any."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.groupBy(key).agg(F.sum(count).alias("mentions"), union(testified).alias("_t"), union(mentioned).alias("_m"))
    return out.select(key, "mentions", F.when(F.size("_t") > 0, F.col("_t")).otherwise(F.col("_m")).alias("sessions"))


def source_ranges(mentions: DataFrame, entity: str, file: str, start: str, end: str, session: str) -> DataFrame:
    """(entity, file, start, end, session): the lines that mentions span in each file, and the least positive session."""
    return mentions.groupBy(entity, file).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.min(F.when(F.col(session) > 0, F.col(session))).alias("session"))


def first_sources(mentions: DataFrame, *key: str, order: list[str]) -> DataFrame:
    """One row of each key, the first by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return mentions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def session_ranges(mentions: DataFrame, entity: str, session: str, line: str, testimony: Column) -> DataFrame:
    """(entity, session, first_line, last_line, n, is_testimony)."""
    return mentions.groupBy(entity, session).agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count("*").alias("n"), F.bool_or(testimony).alias("is_testimony"))


def outcomes(rows: DataFrame, by: str, status: str, kinds: list[str]) -> DataFrame:
    """(by, total, one count for each kind, other): how attempts ended; null and unknown ends are other."""
    counts = [F.count(F.when(F.col(status) == k, 1)).alias(k) for k in kinds]
    other = F.count(F.when(~F.coalesce(F.col(status).isin(*kinds), F.lit(False)), 1)).alias("other")
    return rows.groupBy(by).agg(F.count("*").alias("total"), *counts, other)


def in_order(rows: DataFrame, kind: str, shown: list[str], *then) -> DataFrame:
    """(place, all columns): kinds in a fixed order, unknown ones last, then by the given columns."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, shown)), F.col(kind)), F.lit(0)), F.lit(len(shown) + 1))
    return rows.withColumn("place", place).orderBy("place", *then)


def contexts(rows: DataFrame, key: str, order: list[str], text: str, most: int = 5) -> DataFrame:
    """(key, contexts): the first few different texts of each key. Only those few of a key ever meet."""
    first = rows.groupBy(key, text).agg(F.min(F.struct(*order)).alias("_o"))
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).where(F.col("_r") <= most)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]).alias("contexts"))


def salience(rows: DataFrame, key: str, score: str, otherwise: float = 0.5) -> DataFrame:
    """(key, mentions, salience): average, with a fixed value for rows without one."""
    return rows.groupBy(key).agg(F.count("*").alias("mentions"), F.avg(F.coalesce(score, F.lit(otherwise))).alias("salience"))


def parts_joined(parts: DataFrame, key: str, order: str, text: str, header: Column, rule: str = "\n\n---\n\n") -> DataFrame:
    """(key, text): a header line, then the parts in order with a rule between them."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    body = F.array_join(F.transform(ordered, lambda x: x[text]), rule)
    return parts.groupBy(key).agg(body.alias("_body")).select(key, F.concat(header, F.lit("\n\n"), F.col("_body")).alias("text"))
