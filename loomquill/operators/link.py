"""Entity links in text: [[TYPE:id|surface]] markers put in, parsed, taken out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms that fit one alternation, sent with the task.
MOST_TERMS = 5_000
_MARK = re.compile(r"\[\[.*?\]\]")


def linker(terms: list[tuple[str, str, str]], most: int | None = MOST_TERMS):
    """text -> (marked text, number of links) for (term, type, id): longest term first, whole words, any case,
    never inside a marker, never in a heading or quoted line, never at the edge of bold text."""
    table: dict[str, tuple[str, str]] = {}
    for term, kind, ident in terms:
        table.setdefault(term.lower(), (kind, ident))
    if most is not None and len(table) > most:
        raise ValueError(f"more than {most} terms for one pattern: use link_by_words")
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(table, key=len, reverse=True))) + r")\b", re.I) if table else None

    def one(text: str | None) -> tuple[str | None, int]:
        if not text or pattern is None:
            return text, 0
        n, out = 0, []

        def mark(m: re.Match) -> str:
            nonlocal n
            found = table.get(m[1].lower())
            if found is None or m.string[max(0, m.start() - 2) : m.start()] == "**" or m.string[m.end() : m.end() + 2] == "**":
                return m[0]
            n += 1
            return f"[[{found[0]}:{found[1]}|{m[1]}]]"

        for line in text.split("\n"):
            if line.lstrip().startswith(("#", ">")):
                out.append(line)
                continue
            parts, last = [], 0
            for m in _MARK.finditer(line):
                parts += [pattern.sub(mark, line[last : m.start()]), m[0]]
                last = m.end()
            out.append("".join([*parts, pattern.sub(mark, line[last:])]))
        return "\n".join(out), n

    return one


def link(docs: DataFrame, terms: list[tuple[str, str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, linked, n_links)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = linker(terms)
        for f in frames:
            got = [one(x) for x in f[text]]
            yield pd.DataFrame({key: f[key], "linked": [g[0] for g in got], "n_links": [g[1] for g in got]})

    out = T.StructType([docs.schema[key], T.StructField("linked", T.StringType()), T.StructField("n_links", T.LongType())])
    return docs.select(key, text).mapInPandas(run, out)


def markers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, id, surface) of every marker."""
    p = "\\[\\[([A-Z]+):([^|\\]]+)\\|([^\\]]+)\\]\\]"
    group = lambda i: F.regexp_extract_all(text, F.lit(p), i)
    return docs.select(key, F.explode(F.arrays_zip(group(1).alias("type"), group(2).alias("id"), group(3).alias("surface"))).alias("m")).select(key, "m.type", "m.id", "m.surface")


def term_table(entities: DataFrame, stop: tuple[str, ...] = (), skip: tuple[str, ...] = ("SESSION", "TESTIMONY", "DATE")) -> DataFrame:
    """(term, type, id) of entities (id, type, name, english, ord): their names, and the parts of hyphened names without blanks.

    Terms are longer than two characters (parts: than four) and no stop words. Of entities that share a term in any case, whole names
    come before parts, longer names before shorter ones, then the order.
    """
    name = F.trim("name")
    whole = F.filter(F.array_distinct(F.array_compact(F.array(name, F.trim("english")))), lambda x: F.length(x) > 2)
    parts = F.when(F.contains(name, F.lit("-")) & ~F.contains(name, F.lit(" ")), F.filter(F.split(name, "-"), lambda x: F.length(x) > 4)).otherwise(F.array().cast("array<string>"))
    ranked = F.concat(F.transform(whole, lambda x: F.struct(F.lit(0).alias("p"), x.alias("term"))), F.transform(parts, lambda x: F.struct(F.lit(1).alias("p"), x.alias("term"))))
    rows = entities.where(~F.col("type").isin(*skip)).select("id", "type", "ord", F.length(name).alias("l"), F.explode(ranked).alias("t"))
    rows = rows.where(~F.col("t.term").isin(*stop)) if stop else rows
    best = F.min_by(F.struct("t.term", "type", "id"), F.struct("t.p", -F.col("l"), "ord"))
    return rows.groupBy(F.lower("t.term")).agg(best.alias("x")).select("x.*")


def link_by_words(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, linked, n_links) for any number of terms (term, type, id).

    Each document's words are joined to the terms' first words, so a document gets the terms that it may hold and no others; then it is linked
    as by `link`. Null texts stay null; documents without a term stay as they are.
    """
    first = F.regexp_extract(F.lower("term"), "[\\p{L}\\p{N}_]+", 0)
    dealt = terms.withColumn("_w", first).where("_w <> ''")
    words = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), 1))).alias("_w"))
    own = words.join(dealt, "_w").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("term", "type", "id"))).alias("_terms"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [linker([(r["term"], r["type"], r["id"]) for r in own_], None)(x) if own_ is not None and x else (x, 0) for x, own_ in zip(f[text], f["_terms"], strict=True)]
            yield pd.DataFrame({key: f[key], "linked": [g[0] for g in got], "n_links": [g[1] for g in got]})

    out = T.StructType([docs.schema[key], T.StructField("linked", T.StringType()), T.StructField("n_links", T.LongType())])
    return docs.select(key, text).join(own, key, "left").mapInPandas(run, out)


def targets(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Markers with the entity that their id names; ids that name none go."""
    return found.join(entities.dropDuplicates(["id"]), "id")
