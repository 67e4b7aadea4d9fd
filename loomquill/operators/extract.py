"""Mentions by dictionary and pattern, and their clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most dictionary terms that are sent to all executors; a larger one is joined by tokens.
BROADCAST_TERMS = 50_000


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token) of the runs of letters, repeats included."""
    return docs.select(key, F.explode(F.regexp_extract_all(text, F.lit("(\\p{L}+)"), 1)).alias("token"))


def term_hits(rows: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, n_lines, n_docs): lines with a one-word term, each line once, by an equi-join on tokens."""
    found = rows.select(key, "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("(\\p{L}+)"), 1))).alias("term"))
    small = terms.select(F.lower("term").alias("term")).distinct()
    small = F.broadcast(small) if small.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else small
    return found.join(small, "term").groupBy("term").agg(F.count("*").alias("n_lines"), F.countDistinct(key).alias("n_docs"))


def term_count(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("long")


def pattern_counts(docs: DataFrame, patterns: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, n) of every pattern that matches."""
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for k, p in patterns.items()])
    return docs.select(key, F.explode(counts).alias("x")).select(key, "x.kind", "x.n").where("n > 0")


def good_surface(c: Column, stop: tuple[str, ...] = (), least: int = 4) -> Column:
    """Long enough, with a letter, free of markup, not a stop word."""
    return (F.length(c) >= least) & c.rlike("\\p{L}") & ~c.rlike("[*#\\[\\]|]") & ~F.lower(c).isin(*stop)


def substring_hits(rows: DataFrame, terms: DataFrame, key: str = "doc_id", by_session: str | None = None) -> DataFrame:
    """(entity, n_lines, n_docs): lines that hold any term of an entity anywhere, in words or across them; a line counts once.

    terms: (entity, term). A term of words joins lines on its first whole word, so no line meets the whole table; terms that don't
    hold a whole word inside them can start within a word, and are tried on every line, from a broadcast of bounded size.
    """
    w = "(?<![\\p{L}\\p{N}])[\\p{L}\\p{N}]+(?![\\p{L}\\p{N}])"
    inner = F.get(F.regexp_extract_all("term", F.lit(f"(?<=[^\\p{{L}}\\p{{N}}])({w})(?=[^\\p{{L}}\\p{{N}}])"), 1), F.lit(0))
    dealt = terms.where("term <> ''").distinct().withColumn("_w", inner)
    loose = dealt.where("_w is null").select("entity", "term")
    if loose.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        raise ValueError(f"more than {BROADCAST_TERMS} terms that may start inside a word: use term_hits, which joins on words")
    fixed = dealt.where("_w is not null")
    words = rows.select(key, "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(f"({w})"), 1))).alias("_w"))
    if fixed.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        fixed = F.broadcast(fixed)  # else every word goes through a shuffle with its line
    found = words.join(fixed, "_w").where(F.contains("line", F.col("term"))).select("entity", key, "line_no")
    found = found.union(rows.join(F.broadcast(loose), F.contains(F.col("line"), F.col("term"))).select("entity", key, "line_no"))
    per = found.groupBy("entity", key).agg(F.countDistinct("line_no").alias("_n"))  # one shuffle: by entity and document
    return per.groupBy("entity").agg(F.sum("_n").alias("n_lines"), F.count(key).alias("n_docs"))


def pattern_mentions(docs: DataFrame, patterns: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity, n): how often each entity's pattern is found, in any case."""
    counts = F.array(*[F.struct(F.lit(e).alias("entity"), F.regexp_count(text, F.lit("(?i)" + p)).cast("long").alias("n")) for e, p in patterns])
    return docs.select(key, F.explode(counts).alias("x")).select(key, "x.entity", "x.n").where("n > 0")


def captured(docs: DataFrame, pattern: str, least: int = 3, most: int = 40, around: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, context): each different capture of the pattern's group, of bounded length, with what stands around its first place."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    rows = docs.select(key, text, F.explode(names).alias("name")).where(F.length("name").between(least, most))
    at = F.instr(F.col(text), F.col("name"))
    start = F.greatest(at - around, F.lit(1))
    return rows.select(key, "name", F.substring(F.col(text), start, at + F.length("name") + around - start).alias("context"))


def pattern_sets(docs: DataFrame, patterns: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, names): the different matches of each kind, sorted; kinds without any are left out."""
    sets = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), 1))).alias("names")) for k, p in patterns.items()])
    return docs.select(key, F.explode(sets).alias("x")).select(key, "x.kind", "x.names").where(F.size("names") > 0)


def with_source(rows: DataFrame, *fields: str) -> DataFrame:
    """rows with a struct that says where each comes from."""
    return rows.withColumn("source", F.struct(*fields))


def in_testimony(line: Column, term: Column, before: str = "(witness|sworn|testif)", after: str = "(testif|sworn|witness)") -> Column:
    """Whether a line has the term in a context of testimony: one of the words before or behind it."""
    a = F.regexp_instr(F.lower(line), F.lit(before))
    at = F.instr(line, term)
    return (at > 0) & ((a > 0) & (a < at) | F.substring(F.lower(line), at + F.length(term), F.length(line)).rlike(after))


def near_context(rows: DataFrame, pattern: str, before: int = 5, after: int = 4, key: str = "doc_id") -> DataFrame:
    """rows (key, line_no, line) with `near`: whether the pattern is in some lines around."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-before, after)
    return rows.withColumn("near", F.array_join(F.collect_list("line").over(w), "\n").rlike(pattern))


def spoilt_forms(name: Column) -> Column:
    """How scanned pages may write a name: as it is, its last part, that spaced out, and that spaced out backwards."""
    last = F.try_element_at(F.split(name, " "), F.lit(-1))
    letters = F.filter(F.split(last, ""), lambda x: x != "")
    return F.array_distinct(F.array(name, last, F.array_join(letters, " "), F.array_join(F.reverse(letters), " ")))


def pages_with(pages: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name): pages that hold a form of a name; names is small and goes to every task."""
    forms = names.select("name", spoilt_forms(F.col("name")).alias("_f"))
    return pages.join(F.broadcast(forms), F.exists("_f", lambda f: F.contains(F.col(text), f))).select(key, "name")


def bad_entity(name: Column, key: Column, stop: tuple[str, ...]) -> Column:
    """Whether a name is none: shorter than two, a stop word, up to two signs that aren't all letters, without letters, or marked up."""
    return (F.length(name) < 2) | key.isin(*stop) | ((F.length(key) <= 2) & ~key.rlike("^\\p{L}+$")) | ~key.rlike("\\p{L}") | key.rlike("^[:*]")


def rejected_by_type(kind: Column, name: Column, key: Column, persons: tuple[str, ...], places: tuple[str, ...], organisations: tuple[str, ...], least: int = 4, short: int = 15) -> Column:
    """Whether a name isn't of its kind: too short a key; an organisation that is a known person or place, or one short capital
    word that is no known organisation; a place that is a known person."""
    single = ~F.contains(name, F.lit(" ")) & name.rlike("^\\p{Lu}") & (F.length(name) < short) & ~key.isin(*organisations)
    return (F.length(key) < least) | ((kind == "ORGANIZATION") & (key.isin(*persons) | key.isin(*places) | single)) | ((kind == "LOCATION") & key.isin(*persons))


def capital_runs(text: str) -> list[tuple[str, str, float]]:
    """A stand-in for a model: runs of capitalised words, two or more, as persons."""
    import re

    return [(m[0], "PER", 1.0) for m in re.finditer(r"[A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)+", text)]


def model_entities(docs: DataFrame, predict=capital_runs, types: dict[str, str] | None = None, threshold: float = 0.5, least: int = 2, most: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, kind, score): what a model finds. predict: text to [(name, type, score)], loaded once a task.

    Types that the map lacks go, so do names of other lengths, without a letter, or of a lower score. Null texts give none.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    kinds = types or {"PER": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "ORG": "ORGANIZATION", "EVENT": "EVENT", "DATE": "DATE"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for name, kind, score in predict(x.as_py() or ""):
                    name = name.strip()
                    if kind in kinds and score >= threshold and least <= len(name) <= most and any(c.isalpha() for c in name):
                        rows.append((k, name, kinds[kind], float(score)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)], [key, "name", "kind", "score"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, name string, kind string, score double")


def replayed(answers: DataFrame, schema: str, key: str, answer: str, items: str = "entities") -> DataFrame:
    """(key, fields of the items): stored answers of a service, by a strict schema; answers that don't parse give none."""
    from ..functions.text import unfenced

    parsed = answers.select(key, F.from_json(unfenced(F.col(answer)), schema).alias("x"))
    return parsed.select(key, F.explode(f"x.{items}").alias("e")).select(key, "e.*")
