"""Functions for SQL: `register` names them in a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: SQL expressions of one argument, which the optimizer sees through.
EXPRESSIONS = {
    "canonical_name": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(x)), '^the ', ''), '^a ', ''), '^an ', ''), '^this ', ''), '^that ', ''), '^these ', ''), '^those ', '')",
    "slug": "substring(regexp_replace(trim(regexp_replace(lower(x), '[^\\\\p{L}\\\\p{N}_ \\\\-]', '')), ' +', '-'), 1, 50)",
    "plain_markers": "regexp_replace(x, '\\\\[\\\\[([A-Z]+):([^|\\\\]]+)\\\\|([^\\\\]]+)\\\\]\\\\]', '$3')",
}


@F.udtf(returnType="chunk_id int, line_start int, line_end int, text string")
class ChunkLines:
    """Chunks of lines with `size` characters or more: SELECT * FROM chunk_lines(text, size)."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
        lines = (text or "").split("\n")
        chunk, start, n = 0, 0, 0
        for i, line in enumerate(lines):
            n += len(line) + (i > start)
            if n >= size or i == len(lines) - 1:
                yield chunk, start, i, "\n".join(lines[start : i + 1])
                chunk, start, n = chunk + 1, i + 1, 0


@F.udtf(returnType="type string, id string, surface string")
class ParseMarkers:
    """Markers of a text: SELECT * FROM parse_markers(text)."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str]]:
        import re

        yield from re.findall(r"\[\[([A-Z]+):([^|\]]+)\|([^\]]+)\]\]", text or "")


def register(spark: SparkSession, terms: list[tuple[str, str, str]] | None = None) -> list[str]:
    """Names the functions in the session and returns the names; with terms, link_entities too."""
    from ..operators.link import linker
    from ..sources.html import html_to_markdown

    for name, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    spark.udf.register("html_to_markdown", html_to_markdown)
    spark.udtf.register("chunk_lines", ChunkLines)
    spark.udtf.register("parse_markers", ParseMarkers)
    names = [*EXPRESSIONS, "html_to_markdown", "chunk_lines", "parse_markers"]
    if terms is not None:

        @F.pandas_udf("string")
        def link_entities(c: pd.Series) -> pd.Series:
            one = linker(terms)
            return c.map(lambda x: one(x)[0])

        spark.udf.register("link_entities", link_entities)
        names.append("link_entities")
    return names
