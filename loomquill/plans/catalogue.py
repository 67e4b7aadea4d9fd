"""The catalogue of registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, graph, link, resolve, segment
from ..sources import html
from . import file_queries, graph_queries, span_queries, text_queries  # noqa: F401  they register
from .registry import QUERIES, SQL, query, t, values

def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def doc_lines(s: SparkSession, d: str) -> DataFrame:
    return segment.lines(t(s, d, "documents"))


LINES = "lines AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of common capitalised words that most documents share."""
    return q_cooccur_documents(spark, sf_dir)


@query(f"WITH {LINES} SELECT doc_id, line_no, md5(line) AS line FROM lines")
def q_lines_posexplode(s, d):
    return doc_lines(s, d).select("doc_id", "line_no", F.md5("line").alias("line"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10))) AS cleaned FROM documents")
def q_clean_whitespace(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.collapse_lines(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(?i)password[^\\n]*', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS cleaned FROM documents")
def q_clean_boilerplate(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.clean(F.col("text"), ("password[^\\n]*",))).alias("cleaned"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(text, '\\n\\n+'), lambda p: CASE WHEN regexp_matches(trim(p), '^(>|#|---|\\*\\*\\*|- |\\* |[0-9]+\\. )') THEN trim(p) ELSE trim(regexp_replace(p, '\\s*\\n\\s*', ' ', 'g')) END), lambda p: p <> ''), chr(10) || chr(10))) AS unwrapped FROM documents")
def q_unwrap_paragraphs(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.unwrap(F.col("text"))).alias("unwrapped"))


@query("SELECT p_partkey, 'part-' || CASE WHEN x = '' THEN 'unknown' ELSE x END AS slug FROM (SELECT p_partkey, substring(regexp_replace(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_ \\-]', '', 'g')), ' +', '-', 'g'), 1, 50) AS x FROM part)")
def q_slug(s, d):
    return t(s, d, "part").select("p_partkey", X.slug("part", F.col("p_name")).alias("slug"))


@query("SELECT doc_id, md5(list_reduce(list_prepend(trim(lower(text)), ['the ', 'a ', 'an ', 'this ', 'that ', 'these ', 'those ']), lambda x, p: CASE WHEN starts_with(x, p) THEN substring(x, length(p) + 1) ELSE x END)) AS key FROM documents")
def q_canonical_key(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.match_key(F.col("text"))).alias("key"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS cut FROM documents")
def q_truncate_marker(s, d):
    return t(s, d, "documents").select("doc_id", X.truncated(F.col("text"), 200).alias("cut"))


UNIT = "regexp_replace(printf('%.1f', floor(n_chars / {0}.0 * 10 + 0.5) / 10), '\\.0$', '') || ' {1}'"


@query("SELECT doc_id, CASE WHEN n_chars >= 1073741824 THEN " + UNIT.format(1024**3, "GB") + " WHEN n_chars >= 1048576 THEN " + UNIT.format(1024**2, "MB") + " WHEN n_chars >= 1024 THEN " + UNIT.format(1024, "KB") + " ELSE n_chars || ' B' END AS size FROM documents")
def q_byte_format(s, d):
    return t(s, d, "documents").select("doc_id", X.human_bytes(F.col("n_chars")).alias("size"))


@query("SELECT doc_id, i AS chunk_id, i * 500 AS start, md5(substring(text, i * 500 + 1, 500)) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil(length(text) / 500.0), 1) AS BIGINT))) AS i FROM documents)")
def q_fixed_chunks(s, d):
    return segment.fixed_chunks(t(s, d, "documents"), 500).select("doc_id", "chunk_id", "start", F.md5("chunk").alias("chunk"))


@query(f"WITH {LINES} SELECT doc_id, line_no // 50 AS batch, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY line_no)) AS text FROM lines GROUP BY 1, 2")
def q_line_batches(s, d):
    return segment.line_batches(doc_lines(s, d), 50).select("doc_id", "batch", "n_lines", F.md5("text").alias("text"))


@query("WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS ls FROM documents), r AS (SELECT doc_id, 0 AS i, 0 AS chunk, 0 AS start, ls[1] AS n FROM l UNION ALL SELECT r.doc_id, i + 1, CASE WHEN n >= 4000 THEN chunk + 1 ELSE chunk END, CASE WHEN n >= 4000 THEN i + 1 ELSE start END, CASE WHEN n >= 4000 THEN ls[i + 2] ELSE n + 1 + ls[i + 2] END FROM r JOIN l ON r.doc_id = l.doc_id WHERE i + 1 < len(ls)) SELECT doc_id, chunk AS chunk_id, start AS line_start, max(i) AS line_end, arg_max(n, i) AS n_chars FROM r GROUP BY 1, 2, 3")
def q_greedy_chunks(s, d):
    return segment.packed_chunks(t(s, d, "documents"), 4000)


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events")
def q_session_carry_forward(s, d):
    return segment.carry_forward(t(s, d, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "session").select("event_id", "session")


ISLANDS = """islands AS (SELECT user_id, event_type, island, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2, 3)"""


def event_islands(s, d):
    return segment.intervals(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH {ISLANDS} SELECT user_id, event_type, CAST(island AS BIGINT) AS island, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, start, island) AS r FROM islands) WHERE r = 1")
def q_session_intervals(s, d):
    return segment.longest_per_value(event_islands(s, d), "user_id", "event_type").select("user_id", "event_type", "island", "n")


@query(f"WITH {ISLANDS} SELECT user_id, event_type, CAST(min(island) AS BIGINT) AS island FROM islands GROUP BY 1, 2")
def q_first_island(s, d):
    return segment.first_per_value(event_islands(s, d), "user_id", "event_type").select("user_id", "event_type", "island")


@query(f"WITH {ISLANDS} SELECT e.event_id, CAST(i.island AS BIGINT) AS island FROM events e JOIN islands i ON e.user_id = i.user_id AND e.ts >= i.start AND e.ts <= i.\"end\"")
def q_interval_join(s, d):
    e, i = t(s, d, "events").alias("e"), event_islands(s, d).alias("i")
    return e.join(i, (F.col("e.user_id") == F.col("i.user_id")) & (F.col("e.ts") >= F.col("i.start")) & (F.col("e.ts") <= F.col("i.end"))).select("e.event_id", "i.island")


@query("SELECT c.event_id, (SELECT max(struct_pack(ts := e.ts, v := e.event_id)).v FROM events e WHERE e.user_id = c.user_id AND e.event_type = 'view' AND e.ts <= c.ts) AS as_of FROM events c WHERE event_type = 'purchase'")
def q_asof_marker(s, d):
    e = t(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    best = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return segment.as_of(e.where("event_type = 'purchase'"), best, "user_id", "ts", "mark").select("event_id", F.col("as_of_mark").alias("as_of"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_at FROM events WHERE event_type = 'signup'")
def q_next_marker_span(s, d):
    return segment.spans_to_next(t(s, d, "events").where("event_type = 'signup'"), "user_id", "event_id").select("event_id", "next_at")


@query("SELECT source, doc_id FROM (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY coalesce(l.quality, -1) DESC, n_chars DESC, d.doc_id) AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE r = 1")
def q_best_candidate(s, d):
    j = t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left")
    return segment.best_per_key(j, "source", F.desc(F.coalesce("quality", F.lit(-1))), F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id")


@query("SELECT conv_id, CAST(p AS BIGINT) AS paragraph, count(*) AS n_rows, md5(string_agg(text, ' ' ORDER BY turn)) AS text FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS p FROM conversations) GROUP BY 1, 2")
def q_paragraph_fold(s, d):
    return segment.paragraphs(t(s, d, "conversations"), "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "paragraph", "n_rows", F.md5("text").alias("text"))


TAGGED = "SELECT role, (CASE turn % 7 WHEN 1 THEN '# ' WHEN 2 THEN '---' WHEN 3 THEN '**Q.** ' WHEN 4 THEN '**A.** ' WHEN 5 THEN '**Judge:** ' WHEN 6 THEN '[The Witness is sworn] ' ELSE '' END) || text AS x FROM conversations UNION ALL SELECT role, ' ' FROM conversations"


@query(f"SELECT role, CASE WHEN trim(x) = '' THEN 'blank' WHEN regexp_matches(x, '^#') THEN 'heading' WHEN regexp_matches(x, '^(---|\\*\\*\\*)') THEN 'rule' WHEN regexp_matches(x, '(?i)\\[the witness is sworn\\.?\\]') THEN 'sworn' WHEN regexp_matches(x, '^\\*\\*Q') THEN 'question' WHEN regexp_matches(x, '^\\*\\*A') THEN 'answer' WHEN regexp_matches(x, '^\\*\\*[^*]+:\\*\\*') THEN 'speaker' ELSE 'text' END AS kind, count(*) AS n FROM ({TAGGED}) GROUP BY 1, 2")
def q_speaker_class(s, d):
    c = t(s, d, "conversations")
    mark = F.get(F.array(*map(F.lit, ("", "# ", "---", "**Q.** ", "**A.** ", "**Judge:** ", "[The Witness is sworn] "))), F.col("turn").cast("int") % 7)
    x = c.select("role", F.concat(mark, "text").alias("x")).union(c.select("role", F.lit(" ")))
    return x.groupBy("role", X.context_rule(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


TERMS = "SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM benchmark) WHERE length(w) >= 8"


@query(f"WITH {LINES}, terms AS ({TERMS}), hit AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(lower(line), '\\p{{L}}+')) AS term FROM lines) SELECT term, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM hit JOIN terms USING (term) GROUP BY 1")
def q_dict_line_hits(s, d):
    terms = extract.tokens(t(s, d, "benchmark"), "item_id").where(F.length("token") >= 8).select(F.col("token").alias("term"))
    return extract.term_hits(doc_lines(s, d), terms)


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def q_dict_doc_count(s, d):
    return t(s, d, "documents").select("doc_id", extract.term_count(F.col("text"), "the").alias("n"))


@query("SELECT doc_id, kind, n FROM (SELECT doc_id, 'email' AS kind, len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z]+')) AS n FROM documents UNION ALL SELECT doc_id, 'address', len(regexp_extract_all(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+')) FROM documents UNION ALL SELECT doc_id, 'number', len(regexp_extract_all(text, '[0-9]{4,}')) FROM documents) WHERE n > 0")
def q_pattern_entities(s, d):
    return extract.pattern_counts(t(s, d, "documents"), {"email": "[a-z0-9.]+@[a-z0-9]+\\.[a-z]+", "address": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "number": "[0-9]{4,}"})


@query("SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context FROM conversations")
def q_context_window(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    return t(s, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(F.collect_list("text").over(w), " ")).alias("context"))


@query("SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) WHERE length(w) >= 4 AND lower(w) NOT IN ('that', 'this', 'with', 'from') GROUP BY 1 HAVING count(*) >= 2")
def q_bad_entity_filter(s, d):
    return extract.tokens(t(s, d, "documents")).where(extract.good_surface(F.col("token"), ("that", "this", "with", "from"))).groupBy("token").agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter([c_name, string_split(c_name, ' ')[-1], replace(c_name, '-', ' '), c_name], lambda x: length(x) >= 3))), '|') AS terms FROM customer")
def q_variant_terms(s, d):
    return t(s, d, "customer").select("c_custkey", F.array_join(resolve.variants(F.col("c_name")), "|").alias("terms"))


CASCADE = "WITH i AS (SELECT p_partkey AS ord, p_name AS name, lower(trim(p_name)) AS k2, lower(string_split(trim(p_name), ' ')[-1]) AS k3 FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE 'new ' || p_name END AS query FROM part), u AS (SELECT k3, min(ord) AS ord FROM i GROUP BY 1 HAVING count(*) = 1), h AS (SELECT query, ord, 1 AS tier FROM q JOIN i ON query = name UNION ALL SELECT query, ord, 2 FROM q JOIN i ON lower(trim(query)) = k2 UNION ALL SELECT query, ord, 3 FROM q JOIN u ON lower(string_split(trim(query), ' ')[-1]) = k3) "


def part_cascade(s, d, by_index):
    p = t(s, d, "part")
    k = F.col("p_partkey") % 3
    q = p.select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("new "), "p_name")).alias("query"))
    return resolve.cascade(q, p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name")), by_index)


@query(CASCADE + "SELECT query, ord, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, ord) AS r FROM h) WHERE r = 1")
def q_resolve_cascade(s, d):
    return part_cascade(s, d, False)


@query(CASCADE + "SELECT query, ord, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord, tier) AS r FROM h) WHERE r = 1")
def q_resolve_index_order(s, d):
    return part_cascade(s, d, True)


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE contains(n_name, r_name) OR contains(r_name, n_name))")
def q_containment_anti(s, d):
    n, r = t(s, d, "nation"), t(s, d, "region")  # a fixed table of a few rows on the right
    return n.join(F.broadcast(r), F.col("n_name").contains(F.col("r_name")) | F.col("r_name").contains(F.col("n_name")), "left_anti").select("n_name")


TOKENS = "SELECT w AS token, min(doc_id) AS ord, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY 1"


def token_rows(s, d):
    return extract.tokens(t(s, d, "documents")).where(F.length("token") >= 4).groupBy("token").agg(F.min("doc_id").alias("ord"), F.count("*").alias("n"))


@query(f"SELECT lower(token) AS key, arg_min(token, struct_pack(l := -length(token), o := ord, t := token)) AS name, CAST(sum(n) AS BIGINT) AS mentions, count(DISTINCT token) AS n_names FROM ({TOKENS}) GROUP BY 1")
def q_merge_by_key(s, d):
    return resolve.merge_by_key(token_rows(s, d), F.lower("token"), "token", "ord", "n")


@query("SELECT c AS canonical, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'act' WHEN 'view' THEN 'act' WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'join' END AS c FROM events) WHERE c IS NOT NULL GROUP BY 1")
def q_apply_canonical_map(s, d):
    m = s.createDataFrame([("act", "click"), ("act", "VIEW"), ("buy", "purchase"), ("join", "Signup")], "canonical string, variant string")
    return resolve.apply_map(t(s, d, "events"), F.broadcast(m), "event_type").groupBy("canonical").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey // 7 ELSE l_suppkey END AS a, CASE WHEN l_partkey % 7 = 0 THEN l_partkey // 7 ELSE l_partkey END AS b FROM lineitem")
def q_redirect_edges(s, d):
    e = t(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    ids = e.select(F.explode(F.array("a", "b")).alias("old")).distinct().where("old % 7 = 0")
    return graph.redirect(e, ids.withColumn("new", F.floor(F.col("old") / 7)))


@query("SELECT o_custkey AS a, l_partkey AS b, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def q_bipartite_edges(s, d):
    j = t(s, d, "orders").join(t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.count("*").alias("weight"))


PAIRS = "pairs AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"


def order_pairs(s, d):
    return graph.cooccurrence(t(s, d, "lineitem"), "l_orderkey", "l_partkey")


@query(f"WITH {PAIRS} SELECT a, b, weight FROM pairs")
def q_cooccur_chunk(s, d):
    return order_pairs(s, d)


@query("WITH m AS (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, user_id AS u FROM events) SELECT x.u AS a, y.u AS b, count(*) AS weight FROM m x JOIN m y ON x.h = y.h AND x.u < y.u GROUP BY 1, 2")
def q_cooccur_session(s, d):
    return graph.cooccurrence(t(s, d, "events").select(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("h"), "user_id"), "h", "user_id")


@query("WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM m) WHERE r <= 3) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight FROM c x JOIN c y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2")
def q_cooccur_capped(s, d):
    return graph.cooccurrence(graph.capped(t(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey", ["l_partkey"], 3), "l_orderkey", "l_partkey")


COMMON = "SELECT w FROM (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}{3,}')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, w LIMIT 50)"


@query(f"WITH top AS ({COMMON}), m AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{3,}}')) AS w FROM documents) JOIN top USING (w)) SELECT x.w AS a, y.w AS b, count(*) AS weight FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.w < y.w GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 100")
def q_cooccur_documents(s, d):
    words = t(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(\\p{Lu}\\p{Ll}{3,})"), 1))).alias("w"))
    common = graph.top(words.groupBy("w").agg(F.count("*").alias("n")), 50, F.desc("n"), "w").select("w")  # 50 rows
    return graph.top(graph.cooccurrence(words.join(F.broadcast(common), "w"), "doc_id", "w"), 100, F.desc("weight"), "a", "b")


DEG = f"WITH {PAIRS}, deg AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS w FROM (SELECT a AS node, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) GROUP BY 1) "


@query(DEG + "SELECT node, degree FROM deg")
def q_degree(s, d):
    return graph.degrees(order_pairs(s, d))


@query(DEG + "SELECT node, w AS degree FROM deg")
def q_weighted_degree(s, d):
    return graph.degrees(order_pairs(s, d), "weight")


@query(DEG + "SELECT node, degree, round(15 + ln(degree + 1) / ln((SELECT max(degree) FROM deg) + 1) * 55, 6) AS size FROM deg")
def q_node_size(s, d):
    return graph.node_sizes(graph.degrees(order_pairs(s, d)))


@query(f"WITH {PAIRS} SELECT node, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT b AS node, weight FROM pairs WHERE a = 1 UNION ALL SELECT a, weight FROM pairs WHERE b = 1) GROUP BY 1 ORDER BY weight DESC, node LIMIT 10")
def q_neighbours_topk(s, d):
    return graph.top(graph.neighbours(order_pairs(s, d), 1), 10, F.desc("weight"), "node")


@query("SELECT c_mktsegment AS segment, c_custkey, bal FROM (SELECT c_mktsegment, c_custkey, round(c_acctbal, 2) AS bal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def q_topk_per_group(s, d):
    return graph.capped(t(s, d, "customer"), "c_mktsegment", "c_custkey", [F.desc("c_acctbal")], 5).select(F.col("c_mktsegment").alias("segment"), "c_custkey", F.round("c_acctbal", 2).alias("bal"))


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def q_spine(s, d):
    facts = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return graph.spine(t(s, d, "nation"), facts, "n_nationkey", "n").select("n_name", "n")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types, count(*) AS n FROM events GROUP BY 1")
def q_session_rollup(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def q_type_counts(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


@query("WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM benchmark) SELECT count(*) FILTER (a.w IS NOT NULL AND b.w IS NOT NULL) AS in_both, count(*) FILTER (b.w IS NULL) AS only_left, count(*) FILTER (a.w IS NULL) AS only_right FROM a FULL JOIN b ON a.w = b.w")
def q_set_compare(s, d):
    return resolve.set_compare(extract.tokens(t(s, d, "documents")), extract.tokens(t(s, d, "benchmark"), "item_id"), "token")


@query("SELECT source, count(*) AS total, count(l.doc_id) AS labelled, CAST(coalesce(sum(l.toxic), 0) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def q_coverage(s, d):
    j = t(s, d, "documents").join(t(s, d, "labels").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count("labelled").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_skip_existing(s, d):
    return t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, arg_min(size, prio) AS size FROM (SELECT doc_id, n_chars AS size, 0 AS prio FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, -1, 1 FROM documents) GROUP BY 1")
def q_manifest_merge(s, d):
    docs = t(s, d, "documents")
    both = docs.where("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("size"), F.lit(0).alias("prio")).union(docs.select("doc_id", F.lit(-1).cast("long"), F.lit(1)))
    return segment.best_per_key(both, "doc_id", F.col("prio")).select("doc_id", "size")


def contains_any_case(c: Column, q: str) -> Column:
    return F.contains(F.lower(c), F.lit(q.lower()))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing')")
def q_search_ci(s, d):
    return t(s, d, "documents").where(contains_any_case(F.col("text"), "Thing")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(lower(text), ' '), lambda x: x = 'idiot')) > 0")
def q_search_array(s, d):
    return t(s, d, "documents").where(F.exists(F.split(F.lower("text"), " "), lambda x: x == "idiot")).select("doc_id")


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE contains(lower(line), 'license')")
def q_line_grep(s, d):
    return doc_lines(s, d).where(contains_any_case(F.col("line"), "license")).select("doc_id", "line_no")


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)(thing)', '<mark>\\1</mark>', 'g')) AS marked FROM documents")
def q_highlight(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.highlight(F.col("text"), "thing")).alias("marked"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey <= 5000 THEN 'opening' WHEN o_orderkey <= 20000 THEN 'evidence' ELSE 'closing' END AS phase FROM orders")
def q_phase_case(s, d):
    phases = s.createDataFrame([(0, 5000, "opening"), (5001, 20000, "evidence"), (20001, 2**62, "closing")], "a long, b long, phase string")
    return t(s, d, "orders").join(F.broadcast(phases), (F.col("o_orderkey") >= F.col("a")) & (F.col("o_orderkey") <= F.col("b"))).select("o_orderkey", "phase")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS status FROM orders")
def q_corrections(s, d):
    o = t(s, d, "orders")
    fixes = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("Z").alias("fix"))
    return o.join(fixes, "o_orderkey", "left").select("o_orderkey", F.coalesce("fix", "o_orderstatus").alias("status"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')) AS BIGINT) AS days FROM orders GROUP BY 1")
def q_month_timeline(s, d):
    return t(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max(F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate"))).cast("long").alias("days"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def q_links_extract(s, d):
    return html.links(t(s, d, "pages"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def q_host_dedupe(s, d):
    return t(s, d, "pages").groupBy(html.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query()
def q_html_markdown(s, d):
    return t(s, d, "pages").select("page_id", html.html_to_markdown("html").alias("markdown"))


@query()
def q_link_entities(s, d):
    return link.link(t(s, d, "documents"), [("idiot", "PERSON", "person-idiot"), ("thing", "EVENT", "event-thing")])


PAGES = [("<h1>T</h1><p>a <b>b</b><br>c<script>x</p></script></p><ul><li>i</ul>", "# T\n\na **b**\nc\n\n- i"), ("<style>p{}</style><p>x <i>y</i></p><hr><img alt='z' src=q>", "x *y*\n\n---\n\nz"), ("plain &amp; simple", "plain & simple"), ("", "")]
LINKED = [("Ann Lee met Bob; bob, ANN.", "[[P:p2|Ann Lee]] met [[P:p3|Bob]]; [[P:p3|bob]], [[P:p1|ANN]].", 4), ("# Ann\n> Ann\n**Ann** x", "# Ann\n> Ann\n**Ann** x", 0), ("[[P:p1|Ann]] annex", "[[P:p1|Ann]] annex", 0)]


@query(f"SELECT html, markdown FROM {values(PAGES, 'html, markdown')}")
def q_html_fixed(s, d):
    return s.createDataFrame([(h,) for h, _ in PAGES], "html string").select("html", html.html_to_markdown("html").alias("markdown"))


@query(f"SELECT text, linked, n_links FROM {values(LINKED, 'text, linked, n_links')}")
def q_link_fixed(s, d):
    docs = s.createDataFrame([(x,) for x, _, _ in LINKED], "text string").withColumn("key", F.col("text"))
    return link.link(docs, [("Ann", "P", "p1"), ("Ann Lee", "P", "p2"), ("Bob", "P", "p3")], "key").withColumnRenamed("key", "text")


MARKED = "SELECT n_nationkey, 'In [[LOCATION:' || lower(n_name) || '|' || n_name || ']] and [[EVENT:e1|it]].' AS x FROM nation"


@query(f"SELECT n_nationkey, unnest(regexp_extract_all(x, '\\[\\[([A-Z]+):([^|\\]]+)\\|([^\\]]+)\\]\\]', 1)) AS type, unnest(regexp_extract_all(x, '\\[\\[([A-Z]+):([^|\\]]+)\\|([^\\]]+)\\]\\]', 3)) AS surface, regexp_replace(x, '\\[\\[([A-Z]+):([^|\\]]+)\\|([^\\]]+)\\]\\]', '\\3', 'g') AS plain FROM ({MARKED})")
def q_marker_parse(s, d):
    n = t(s, d, "nation").select("n_nationkey", F.concat(F.lit("In [[LOCATION:"), F.lower("n_name"), F.lit("|"), "n_name", F.lit("]] and [[EVENT:e1|it]].")).alias("x"))
    found = link.markers(n, "n_nationkey", "x").select("n_nationkey", "type", "surface")
    return found.join(n.select("n_nationkey", X.without_markers(F.col("x")).alias("plain")), "n_nationkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN (p_partkey * 37) % 612 > 306 THEN 0 ELSE 1 END, (p_partkey * 91) % 800, (p_partkey * 37) % 612, p_partkey) AS place FROM part")
def q_column_order(s, d):
    b = t(s, d, "part").select("p_partkey", F.col("p_size").alias("page"), ((F.col("p_partkey") * 37) % 612).alias("x0"), ((F.col("p_partkey") * 91) % 800).alias("y"))
    return segment.column_order(b.withColumn("y0", F.struct("y", "x0", "p_partkey"))).select("p_partkey", "place")


BLOCKS = "b AS (SELECT p_partkey, p_size AS page, CASE WHEN p_size % 2 = 1 THEN (p_partkey * 37 % 100) / 1000.0::DOUBLE + (p_partkey % 2) * 0.6::DOUBLE ELSE (p_partkey * 37 % 300) / 1000.0::DOUBLE END AS x, p_partkey * 91 % 800 AS y FROM part), g AS (SELECT *, x - lag(x) OVER (PARTITION BY page ORDER BY x) AS gap FROM b), s AS (SELECT page, max(x) - min(x) > 0.4 AS two, CASE WHEN max(gap) >= 0.1 THEN arg_max(x - gap / 2, struct_pack(g := gap, x := -x)) ELSE 0.5 END AS edge FROM g GROUP BY 1)"


@query(f"WITH {BLOCKS} SELECT p_partkey, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN two AND x <= edge THEN 1 ELSE 0 END, y, p_partkey) AS place FROM b JOIN s USING (page)")
def q_adaptive_columns(s, d):
    k = F.col("p_partkey")
    x = F.when(F.col("p_size") % 2 == 1, (k * 37 % 100) / F.lit(1000.0) + (k % 2) * F.lit(0.6)).otherwise((k * 37 % 300) / F.lit(1000.0))
    return segment.adaptive_column_order(t(s, d, "part").select("p_partkey", F.col("p_size").alias("page"), x.alias("x"), (k * 91 % 800).alias("y")), "p_partkey").select("p_partkey", "place")


@query(f"WITH {LINES}, near AS (SELECT doc_id, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS x FROM lines) SELECT doc_id, min(line_no) AS line_no FROM near WHERE contains(line, 'license') AND (contains(x, 'thing') OR contains(x, 'the')) GROUP BY 1")
def q_marker_near_name(s, d):
    return segment.first_marker_near(t(s, d, "documents"), "license", ["thing", "the"])


@query("SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cell FROM events")
def q_blanks_inherit(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("cell"))
    return segment.blanks_inherit(e, "user_id", ["ts", "event_id"], "cell").select("event_id", "cell")


NAMED = "e AS (SELECT p_partkey AS ord, p_name AS name, p_brand || p_size AS key, CAST(p_size AS BIGINT) AS mentions, p_partkey % 7 AS session FROM part), o AS (SELECT * FROM e WHERE ord % 2 = 1), l AS (SELECT * FROM e WHERE ord % 2 = 0), k AS (SELECT DISTINCT key FROM e WHERE mentions = 1), p AS (SELECT DISTINCT key FROM e WHERE mentions = 2)"


@query(f"WITH {NAMED}, gone AS (SELECT key, sum(mentions) AS m, list(session) AS s FROM o WHERE key IN (SELECT key FROM l) GROUP BY 1), h AS (SELECT key, min(ord) AS ord FROM l GROUP BY 1) SELECT 'location' AS kind, l.ord, l.name, CAST(l.mentions + coalesce(m, 0) AS BIGINT) AS mentions, len(list_distinct(list_concat([session], coalesce(s, [])))) AS n_sessions FROM l LEFT JOIN h ON l.ord = h.ord LEFT JOIN gone ON gone.key = h.key UNION ALL SELECT 'organization', ord, name, mentions, 1 FROM o WHERE key NOT IN (SELECT key FROM l) AND key NOT IN (SELECT key FROM k) AND key NOT IN (SELECT key FROM p)")
def q_merge_cross_type(s, d):
    e = t(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat("p_brand", F.col("p_size").cast("string")).alias("key"), F.col("p_size").cast("long").alias("mentions"), F.array(F.col("p_partkey") % 7).alias("sessions"))
    out = resolve.merge_cross_type(e.where("ord % 2 = 1"), e.where("ord % 2 = 0"), e.where("mentions = 1"), e.where("mentions = 2"))
    return out.select("kind", "ord", "name", "mentions", F.size("sessions").alias("n_sessions"))


@query("WITH r AS (SELECT s_suppkey AS idx, s_name AS name, s_nationkey + 1 AS mentions FROM supplier), g AS (SELECT idx % 11 AS grp, idx AS pos, idx FROM r WHERE mentions < 12 UNION ALL SELECT 100 + idx % 5, -idx, idx FROM r WHERE mentions > 8), f AS (SELECT idx, min(struct_pack(grp := grp, pos := pos)) AS g FROM g GROUP BY 1), m AS (SELECT r.*, f.g.grp IS NULL AS alone, coalesce(f.g.grp, r.idx) AS id, f.g.pos AS pos FROM r LEFT JOIN f USING (idx)) SELECT b.idx AS idx, b.name AS name, mentions, n_members FROM (SELECT arg_min(struct_pack(idx := idx, name := name), struct_pack(p := coalesce(pos, 0), i := idx)) AS b, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) AS n_members FROM m GROUP BY alone, id)")
def q_merge_groups(s, d):
    r = t(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name"), (F.col("s_nationkey") + 1).alias("mentions"))
    g = r.where("mentions < 12").select((F.col("idx") % 11).alias("grp"), F.col("idx").alias("pos"), "idx").union(r.where("mentions > 8").select(100 + F.col("idx") % 5, -F.col("idx"), "idx"))
    return resolve.merge_groups(r, g)


LIMITS = {"PERSON": 3, "LOCATION": 2, "EVENT": 1}


@query("WITH lim AS (SELECT unnest(['PERSON', 'LOCATION', 'EVENT']) AS type, unnest([3, 2, 1]) AS k), e AS (SELECT s_suppkey AS node, s_nationkey AS session, ['PERSON', 'LOCATION', 'EVENT'][CAST(s_suppkey % 3 + 1 AS BIGINT)] AS type, -s_acctbal AS ord FROM supplier), near AS (SELECT * FROM (SELECT c_custkey AS key, node, type, k, row_number() OVER (PARTITION BY c_custkey, type ORDER BY ord, node) AS r FROM customer JOIN e ON session = c_nationkey JOIN lim USING (type)) WHERE r <= k), first AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord, node) AS r FROM e), n AS (SELECT key, type, count(*) AS n FROM near GROUP BY 1, 2) SELECT key, node, type, 'MENTIONED_IN' AS edge, 2 AS weight FROM near UNION ALL SELECT c_custkey, f.node, f.type, 'RELATED_TO', 1 FROM customer JOIN first f ON f.r <= 3 JOIN lim ON lim.type = f.type LEFT JOIN n ON n.key = c_custkey AND n.type = f.type WHERE f.r <= lim.k - coalesce(n, 0)")
def q_linked_padding(s, d):
    e = t(s, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("session"), F.get(F.array(*map(F.lit, LIMITS)), (F.col("s_suppkey") % 3).cast("int")).alias("type"), (-F.col("s_acctbal")).alias("ord"))
    return graph.padded_links(t(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("session")), e.select("node", "session"), e.select("node", "type", "ord"), LIMITS)


@query("WITH m AS (SELECT l_partkey AS node, count(*) AS mentions FROM lineitem GROUP BY 1) SELECT node, mentions FROM m WHERE node % 10 <> 0 AND node IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 UNION ALL SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1)) ORDER BY mentions DESC, node LIMIT 30")
def q_two_hop_top30(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part, order = F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 19, "0")), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), part.alias("b"), F.lit("SUPPLIES").alias("type")).union(li.select(part, order, F.lit("MENTIONED_IN")))
    nodes = li.groupBy("l_partkey").agg(F.count("*").alias("mentions")).select(part.alias("node"), "mentions", (F.col("l_partkey") % 10 == 0).alias("hidden"), F.col("l_partkey").alias("_k"))
    found = graph.linked_nodes(edges, "s1", li.where("l_suppkey = 1").select(order.alias("session")), nodes)
    return found.select(F.col("_k").alias("node"), "mentions")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_event_window(s, d):
    """Extension: the reference has no event-time windows."""
    return t(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n")
