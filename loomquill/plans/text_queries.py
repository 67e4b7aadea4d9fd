"""Queries of the cleaners. Hebrew and other odd cases come from a few fixed rows, the rest from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import segment
from ..sources import html
from .registry import query, t, values


def over(s, rows: list[str | None], f):
    """(x, y) of a cleaner over fixed texts."""
    return s.createDataFrame([(r,) for r in rows], "x string").select("x", f(F.col("x")).alias("y"))


MARKS = ["ד״ר כהן", "א‏ב ׳ג׳", "plain", "", None]


@query(f"SELECT x, translate(regexp_replace(x, '[‎‏‪-‮⁦-⁩]', '', 'g'), '״׳', '\"''') AS y FROM {values([(m,) for m in MARKS], 'x')}")
def q_plain_quotes(s, d):
    return over(s, MARKS, X.plain_quotes)


SPOILT = ["שוור  'א'ב “c” ׳", "a'b  c\n d", "וווו", "", None]


@query(f"SELECT x, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '[״“”]', '\"', 'g'), '[׳‘’]', '''', 'g'), '([\\p{{L}}\\p{{N}}_])''([\\p{{L}}\\p{{N}}_])', '\\1׳\\2', 'g'), 'וו', 'ו'), '\\s+', ' ', 'g')) AS y FROM {values([(m,) for m in SPOILT], 'x')}")
def q_ocr_repair(s, d):
    return over(s, SPOILT, X.ocr_repair)


POINTED = ["שָׁלוֹם  \"עולם\"", "׳א׳ ב", "abc", "", None]


@query(f"SELECT x, trim(regexp_replace(regexp_replace(x, '[֑-ׇ\"''״׳]', '', 'g'), '\\s+', ' ', 'g')) AS y FROM {values([(m,) for m in POINTED], 'x')}")
def q_without_points(s, d):
    return over(s, POINTED, X.without_points)


TITLED = [("ד\"ר כהן", "כהן"), ("מר העד לוי", "לוי"), ("השופט הלוי", "הלוי"), ("פרופ' סלו", "סלו"), ("גב' מר", "מר"), ("דרור", "דרור"), ("", "")]


@query(f"SELECT x, y FROM {values(TITLED, 'x, y')}")
def q_without_titles(s, d):
    return over(s, [x for x, _ in TITLED], X.without_titles)


@query("SELECT s_suppkey, trim(regexp_replace(lower(trim(x)), '^(dr|prof|judge)\\.? +', '')) AS key FROM (SELECT s_suppkey, (['Dr. ', 'PROF ', 'Judge  ', 'Drum '])[CAST(s_suppkey % 4 + 1 AS BIGINT)] || s_name AS x FROM supplier)")
def q_name_key(s, d):
    title = F.get(F.array(*map(F.lit, ("Dr. ", "PROF ", "Judge  ", "Drum "))), (F.col("s_suppkey") % 4).cast("int"))
    return t(s, d, "supplier").select("s_suppkey", X.name_key(F.concat(title, "s_name")).alias("key"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(x, '^[*:#\\s]+|[*:#\\s]+$', '', 'g'), '^[.,;:!?()\\[\\]{}\"''\\-]+|[.,;:!?()\\[\\]{}\"''\\-]+$', '', 'g')), ' +', ' ', 'g') AS name FROM (SELECT p_partkey, '**' || p_name || '  x,:*' AS x FROM part)")
def q_surface(s, d):
    return t(s, d, "part").select("p_partkey", X.surface(F.concat(F.lit("**"), "p_name", F.lit("  x,:*"))).alias("name"))


@query("SELECT w, CASE WHEN w = lower(w) THEN upper(left(w, 1)) || substring(w, 2) ELSE w END AS shown FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM benchmark)")
def q_title_if_lower(s, d):
    words = t(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("w")).distinct()
    return words.select("w", X.title_if_lower(F.col("w")).alias("shown"))


NAMES = [("העד יוסף כהן.", "יוסף כהן"), ("משה לוי של העיר", "משה לוי"), ("אב של גד", None), ("Abba Kovner", None), ("אב", None), ("רחל (רוזן):", "רחל (רוזן"), (None, None)]


@query(f"SELECT x, y FROM {values(NAMES, 'x, y')}")
def q_witness_name(s, d):
    return over(s, [x for x, _ in NAMES], X.witness_name)


ANSWERED = [("Anna  Bern - my name is", "Anna Bern"), ("Carl Dunn née Frey", "Carl Dunn"), ("Emil Gold - a clerk", "Emil Gold"), ("Yes", None), ("I do.", None), ("Hans Ilk..", "Hans Ilk"), (None, None)]


@query(f"SELECT x, y FROM {values(ANSWERED, 'x, y')}")
def q_answered_name(s, d):
    return over(s, [x for x, _ in ANSWERED], X.answered_name)


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)licensed under.*?\\.', '', 'g'), '(\\s*---\\s*\\n){2,}', chr(10) || '---' || chr(10) || chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS kept FROM documents")
def q_without_artifacts(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.without_artifacts(F.col("text"), ("licensed under.*?\\.",))).alias("kept"))


LINES_OF = "(SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*[0-9]+\\s*$') AND NOT (contains(x, 'The') AND length(x) < 50) AND NOT regexp_matches(x, '^\\s*(?i:session)\\s+(no\\.?\\s*)?[0-9]+\\s*$')), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)"


@query(f"SELECT doc_id, md5(array_to_string(ls, chr(10))) AS kept FROM {LINES_OF}")
def q_transcript_lines(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.transcript_lines(F.col("text"), "The")).alias("kept"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(\\*\\*[^*\\n]+:\\*\\*)([^\\s*])', '\\1 \\2', 'g'), ',([a-zA-Z])', ', \\1', 'g'), '([a-z])\\.([A-Z])', '\\1. \\2', 'g')) AS kept FROM documents")
def q_spaced_marks(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.spaced_marks(F.col("text"))).alias("kept"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS fenced FROM events")
def q_fenced_json(s, d):
    e = t(s, d, "events")
    fenced = F.col("event_id") % 3 == 0
    text = F.when(fenced, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.col("props"))
    return e.select("event_id", F.from_json(X.unfenced(text), "k long")["k"].alias("k"), fenced.alias("fenced"))


@query("SELECT conv_id, turn, md5(replace(replace('**' || role || ':** ' || text || ' [a](b)', '**' || role || ':**', role || ':'), '[a](b)', 'a')) AS plain FROM conversations WHERE NOT regexp_matches(text, '[*`\\[]') UNION ALL SELECT conv_id, turn, md5('x y z') FROM conversations WHERE regexp_matches(text, '[*`\\[]')")
def q_plain_inline(s, d):
    c = t(s, d, "conversations")
    marked = F.when(F.col("text").rlike("[*`\\[]"), F.lit("**x** *y* `z`")).otherwise(F.concat(F.lit("**"), "role", F.lit(":** "), "text", F.lit(" [a](b)")))
    return c.select("conv_id", "turn", F.md5(X.plain_inline(marked)).alias("plain"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS shown FROM pages")
def q_escaped(s, d):
    return t(s, d, "pages").select("page_id", F.md5(X.escaped(F.col("html"))).alias("shown"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INTEGER) AS session, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<nav.*?</nav>', '', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body FROM pages")
def q_page_extract(s, d):
    return html.page(t(s, d, "pages"), "/([0-9]+)").select("page_id", "title", "session", F.md5("body").alias("body"))


LINE = "lines AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query(f"WITH {LINE} SELECT doc_id, CAST(section AS BIGINT) AS section, min(line_no) AS first_line, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY line_no)) AS text FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^(#{{1,6}} |[0-9]+\\. |[A-Z][a-z]+\\.$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM lines) GROUP BY 1, 2")
def q_sections(s, d):
    rows = segment.lines(t(s, d, "documents"))
    return segment.sections(rows, "^(#{1,6} |[0-9]+\\. |[A-Z][a-z]+\\.$)").select("doc_id", "section", "first_line", "n_lines", F.md5("text").alias("text"))


@query(f"WITH {LINE} SELECT doc_id, coalesce(min(CASE WHEN contains(line, 'the ') THEN line_no END), 12) AS body_start FROM lines GROUP BY 1")
def q_body_start(s, d):
    return segment.body_start(segment.lines(t(s, d, "documents")), F.contains("line", F.lit("the ")), 12).withColumn("body_start", F.col("body_start").cast("long"))


@query("SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text || chr(10) || '1. a ' || role || chr(10) || '2) b', '(?m)^[0-9]+[.)] *(.+)$', 1)[1:3], lambda x: x), '|') AS asked FROM (SELECT conv_id, turn, role, '' AS text FROM conversations)")
def q_follow_ups(s, d):
    c = t(s, d, "conversations")
    text = F.concat("text", F.lit("\n---\n1. a "), "role", F.lit("\n2) b"))
    return c.select("conv_id", "turn", F.array_join(X.follow_ups(text), "|").alias("asked"))


@query("SELECT n_nationkey, regexp_replace(regexp_replace(n_name || ' (a/b) é', '[^\\p{L}\\p{N}_\\s\\-]', '', 'g'), ' ', '_', 'g') AS file FROM nation")
def q_file_name(s, d):
    return t(s, d, "nation").select("n_nationkey", X.file_name(F.concat("n_name", F.lit(" (a/b) é"))).alias("file"))
