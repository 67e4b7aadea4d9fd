"""Queries of sources, sinks, streams and registered functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered
from ..sinks import export
from ..sources import files, html
from ..streaming import ingest
from .registry import query, t, values

NAMES = [("vol3_summary.txt", "summary", 3, None, None, None), ("Vol5_band12.txt", "statement", 5, 12, None, None), ("vol1_p14.txt", "sessions", 1, None, 1, 14), ("Vol1_p114.txt", "sessions", 1, None, 1, 14), ("vol2_p1529.txt", "sessions", 2, None, 15, 29), ("vol1_p15291.txt", "sessions", 1, None, 15, 29), ("vol3_p090100.txt", "sessions", 3, None, 90, 100), ("claims1.txt", "claims", None, None, None, None), ("x.txt", "unknown", None, None, None, None)]


@query(f"SELECT name, kind, volume, band, first, last FROM {values(NAMES, 'name, kind, volume, band, first, last')}")
def q_file_attributes(s, d):
    return s.createDataFrame([(r[0],) for r in NAMES], "name string").select("name", *files.attributes(F.col("name"), {"claims1": "claims"}))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_nationkey::VARCHAR WHEN 1 THEN '6,7,8' END AS sessions, s_suppkey % 5 AS volume, '2 May 1961' AS date FROM supplier")
def q_session_headers(s, d):
    k = F.col("s_suppkey")
    head = F.when(k % 3 == 0, F.concat(F.lit("**Session:** "), F.col("s_nationkey").cast("string"))).when(k % 3 == 1, F.lit("**Sessions:** 6, 7, 8")).otherwise(F.lit("no header"))
    text = F.concat(head, F.lit("\n**Volume:** "), (k % 5).cast("string"), F.lit("\n16 Iyar, 5721 (2 May 1961)\nText."))
    rows = files.with_header(t(s, d, "supplier").select("s_suppkey", text.alias("text")))
    return rows.select("s_suppkey", F.array_join("sessions", ",").alias("sessions"), F.col("volume").cast("long").alias("volume"), "date")


@query("SELECT file, CASE WHEN contains(file, 'b') THEN 'Letters' WHEN contains(file, 'a') THEN 'Notes' ELSE 'Other' END AS description FROM (SELECT unnest(['a1', 'b2', 'c3']) AS file)")
def q_described(s, d):
    rows = s.createDataFrame([("a1",), ("b2",), ("c3",)], "file string")
    return rows.select("file", files.described(F.col("file"), [("B", "Letters"), ("a", "Notes")], "Other").alias("description"))


@query("SELECT page_id, TRY_CAST(x[1] AS INTEGER) AS session, 1 AS part FROM (SELECT DISTINCT page_id, regexp_extract_all(html, 'track\\(([0-9]+)\\)', 1) AS x FROM pages) WHERE len(x) > 0")
def q_part_links(s, d):
    """Addresses with a session and, it may be, a part."""
    return html.part_links(t(s, d, "pages"), "track\\(([0-9]+)\\)()")


@query("SELECT session, part FROM (SELECT o_custkey % 7 AS session, unnest(range(1, max(o_orderkey % 5 + 1) + 10)) AS part FROM orders GROUP BY 1) EXCEPT SELECT o_custkey % 7, o_orderkey % 5 + 1 FROM orders")
def q_missing_parts(s, d):
    known = t(s, d, "orders").select((F.col("o_custkey") % 7).alias("session"), (F.col("o_orderkey") % 5 + 1).alias("part"))
    return html.missing_parts(known)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_embedded_json(s, d):
    page = F.concat(F.lit("<script>var data = "), "props", F.lit(";</script>"))
    return t(s, d, "events").select("event_id", html.embedded_json(page, "data", "k long")["k"].alias("k"))


@query("SELECT n_nationkey AS page_id, 'a' || n_nationkey || '.jpg' AS file, n_name AS name FROM nation UNION ALL SELECT n_nationkey, 'b.png', 'other' FROM nation")
def q_title_dedupe(s, d):
    name = F.col("n_name")
    link = F.concat(F.lit('<a href="/x/a'), F.col("n_nationkey").cast("string"), F.lit('.jpg" title="'), name, F.lit('">'))
    image = F.concat(F.lit('<img src="/y/a'), F.col("n_nationkey").cast("string"), F.lit('.jpg" alt="late"><img src="b.png" alt="other"><img src="/z/b.png" alt="later">'))
    pages = t(s, d, "nation").select(F.col("n_nationkey").alias("page_id"), F.concat(image, link).alias("html"))
    return html.named_files(pages)


@query("SELECT (SELECT count(*) FROM supplier) AS total, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS done, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS failed, (SELECT md5(string_agg(s_name, ',' ORDER BY s_name)) FROM supplier WHERE s_suppkey % 3 = 0) AS failures")
def q_export_index(s, d):
    rows = t(s, d, "supplier").select("s_name", F.when(F.col("s_suppkey") % 3 == 0, "failed").otherwise("done").alias("status"))
    return export.index(rows, "s_name", "status").withColumn("failures", F.md5(F.array_join("failures", ",")))


@query("SELECT user_id, count(DISTINCT event_id) AS n_events FROM events GROUP BY 1")
def q_light_index(s, d):
    rows = t(s, d, "events").groupBy("user_id").agg(F.collect_set("event_id").alias("events"))
    return export.two_forms(rows, ["user_id"], "events")[1]


@query("SELECT doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'uploaded' END AS outcome FROM documents UNION ALL SELECT doc_id, 'skipped' FROM documents WHERE doc_id % 2 = 0")
def q_sent(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("name"))
    return export.sent(docs.union(docs.where("name % 2 = 0")), docs.where("name % 3 = 0"))


@query("SELECT doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE n_chars END AS size FROM documents")
def q_manifest_upsert(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))
    manifest = docs.where("name % 3 = 0").withColumn("size", F.lit(-1).cast("long"))
    return export.upsert(manifest, export.sent(docs, manifest.select("name")))


@query("SELECT s_suppkey, md5('# Testimony of ' || s_name || chr(10) || chr(10) || '**Session:** ' || s_nationkey || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'x' || chr(10)) AS text FROM supplier")
def q_testimony_text(s, d):
    return t(s, d, "supplier").select("s_suppkey", F.md5(export.testimony_text(F.col("s_name"), F.col("s_nationkey"), F.lit("x"))).alias("text"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_ \\-]', '', 'g')), ' +', '-', 'g') AS slug, regexp_replace(trim(lower('The ' || p_name)), '^the ', '') AS name FROM part")
def q_registered_functions(s, d):
    registered.register(s)
    t(s, d, "part").createOrReplaceTempView("loomquill_part")
    return s.sql("SELECT p_partkey, slug(p_name) AS slug, canonical_name('The ' || p_name) AS name FROM loomquill_part")


@query("SELECT doc_id, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def q_chunk_function(s, d):
    """Chunks cover all lines: their lengths and line ends add up to the text's."""
    registered.register(s)
    t(s, d, "documents").createOrReplaceTempView("loomquill_documents")
    return s.sql("SELECT doc_id, sum(length(c.text) + 1) - 1 AS n_chars FROM loomquill_documents, LATERAL chunk_lines(text, 500) c GROUP BY doc_id")


@query("SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def x_session_window(s, d):
    """Extension: sessions of events by a gap, as a stream would make them."""
    out = ingest.sessions(t(s, d, "events"), "ts", "6 hours", "1 day", "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT CAST(epoch(w) AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS w FROM events UNION ALL SELECT event_type, time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour FROM events) GROUP BY 1, 2")
def x_sliding_window(s, d):
    """Extension: windows of two hours, one each hour."""
    out = ingest.windowed(t(s, d, "events"), "ts", "2 hours", "1 day", "event_type", slide="1 hour")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")
