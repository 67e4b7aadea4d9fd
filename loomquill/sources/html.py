"""Raw pages: HTML to Markdown by the standard library's parser, and link extraction by expression."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROP, _BREAK = {"script", "style", "form", "nav"}, {"p", "div", "blockquote", "ul", "ol", "center", "table"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _DROP:
            self.quiet += 1
        elif tag in ("b", "strong", "i", "em"):
            self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "img":
            self.out.append(dict(attrs).get("alt") or "")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in _BREAK:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROP:
            self.quiet = max(0, self.quiet - 1)
        elif tag in ("b", "strong", "i", "em"):
            self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag in _BREAK or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.out.append(data)


def markdown(html: str | None) -> str:
    import re

    p = _Markdown()
    p.feed(html or "")
    p.close()
    text = re.sub(r"[ \t]+", " ", "".join(p.out))
    return re.sub(r"\s*\n\s*\n\s*", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(c: pd.Series) -> pd.Series:
    return c.map(markdown)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href) of every link, repeats included."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("href"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def without_blocks(c: Column, tags: tuple[str, ...] = ("script", "style", "nav", "form")) -> Column:
    """A page's source less what these tags hold."""
    for tag in tags:
        c = F.regexp_replace(c, f"(?is)<{tag}.*?</{tag}>", "")
    return c


def page(pages: DataFrame, session: str, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, title, session, body): title element, the number that the pattern finds in the address (null if none), text without tags."""
    body = F.trim(F.regexp_replace(F.regexp_replace(without_blocks(F.col(html)), "<[^>]*>", " "), "\\s+", " "))
    number = F.nullif(F.regexp_extract(url, session, 1), F.lit("")).try_cast("int")
    return pages.select(key, F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), number.alias("session"), body.alias("body"))


def part_links(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, session, part) of links whose address has the pattern's two numbers, each pair once a page; a missing part is 1."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("session"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("part"))
    rows = pages.select(key, F.explode(found).alias("x")).select(key, F.col("x.session").cast("int").alias("session"), F.coalesce(F.nullif("x.part", F.lit("")).cast("int"), F.lit(1)).alias("part"))
    return rows.distinct()


def missing_parts(known: DataFrame, ahead: int = 9) -> DataFrame:
    """(session, part): numbers from 1 to the greatest known part and some beyond that aren't known, to be looked for."""
    every = known.groupBy("session").agg(F.max("part").alias("m")).select("session", F.explode(F.sequence(F.lit(1), F.col("m") + ahead)).alias("part"))
    return every.join(known.select("session", "part").distinct(), ["session", "part"], "left_anti")


def embedded_json(c: Column, name: str, schema: str) -> Column:
    """What a script assigns to a variable, by a schema; null where there is no such assignment or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, f"(?s)var {name} *= *(.*?);\\s*(?:</script>|$|\n|track)", 1), F.lit("")), schema)


def named_files(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, file, name) of links with a title and images with an alternative text, by file name; the first of a page wins, links before images."""

    def found(pattern: str, kind: int) -> DataFrame:
        pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("ref"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("name"))
        return pages.select(key, F.posexplode(pairs).alias("at", "x")).select(key, F.lit(kind).alias("kind"), "at", F.regexp_extract("x.ref", "([^/]*)$", 1).alias("file"), F.col("x.name").alias("name"))

    both = found('<a [^>]*href="([^"]*)"[^>]*title="([^"]*)"', 0).union(found('<img [^>]*src="([^"]*)"[^>]*alt="([^"]*)"', 1))
    return both.groupBy(key, "file").agg(F.min_by("name", F.struct("kind", "at")).alias("name"))
