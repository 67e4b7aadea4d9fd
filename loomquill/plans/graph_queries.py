"""Queries of rollups, joins, resolution, filters, orders and graph assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, resolve, rollup
from .registry import query, t, values

# Rollups -------------------------------------------------------------------------------------------------------------


@query("SELECT substring(lower(p_name), 1, 6) AS key, CAST(sum(p_size) AS BIGINT) AS mentions, count(DISTINCT p_name) AS n_names, arg_min(p_name, struct_pack(l := -length(p_name), n := p_name)) AS name FROM part GROUP BY 1")
def q_prefix_merge(s, d):
    return rollup.by_prefix(t(s, d, "part"), F.lower("p_name"), 6, "p_size", "p_name")


@query("SELECT event_type, count(*) AS n, md5(string_agg(event_id, ',' ORDER BY ts, event_id)) AS ids FROM events GROUP BY 1")
def q_appearances(s, d):
    out = rollup.appearances(t(s, d, "events"), "event_type", ["ts", "event_id"])
    return out.select("event_type", "n", F.md5(F.array_join(F.transform("appearances", lambda x: x["event_id"].cast("string")), ",")).alias("ids"))


MENTIONS = "m AS (SELECT user_id AS entity, CAST(event_id % 13 AS INTEGER) AS session, CAST(event_id % 500 AS INTEGER) AS line, event_type FROM events)"


def mentions(s, d):
    e = t(s, d, "events")
    return e.select(F.col("user_id").alias("entity"), (F.col("event_id") % 13).cast("int").alias("session"), (F.col("event_id") % 500).cast("int").alias("line"), "event_type", "event_id")


@query(f"WITH {MENTIONS}, g AS (SELECT entity, count(*) AS mentions, list_sort(list_distinct(coalesce(list(session) FILTER (event_type = 'signup'), []))) AS a, list_sort(list_distinct(list(session))) AS b FROM m GROUP BY 1) SELECT entity, mentions, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ',') AS sessions FROM g")
def q_session_preference(s, d):
    m = mentions(s, d).withColumns({"a": F.when(F.col("event_type") == "signup", F.array("session")).otherwise(F.array().cast("array<int>")), "b": F.array("session"), "n": F.lit(1)})
    return rollup.merged_sessions(m, "entity", "a", "b", "n").select("entity", "mentions", F.array_join("sessions", ",").alias("sessions"))


@query(f"WITH {MENTIONS} SELECT entity, event_type, min(line) AS start, max(line) AS \"end\", min(CASE WHEN session > 0 THEN session END) AS session FROM m GROUP BY 1, 2")
def q_source_ranges(s, d):
    return rollup.source_ranges(mentions(s, d).withColumn("stop", F.col("line")), "entity", "event_type", "line", "stop", "session")


@query(f"WITH {MENTIONS} SELECT entity, session, min(line) AS line FROM m GROUP BY 1, 2")
def q_source_dedupe(s, d):
    return rollup.first_sources(mentions(s, d), "entity", "session", order=["line", "event_id"]).select("entity", "session", "line")


@query(f"WITH {MENTIONS} SELECT entity, session, min(line) AS first_line, max(line) AS last_line, count(*) AS n, bool_or(event_type = 'signup') AS is_testimony FROM m GROUP BY 1, 2")
def q_session_ranges(s, d):
    return rollup.session_ranges(mentions(s, d), "entity", "session", "line", F.col("event_type") == "signup")


@query("WITH d AS (SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1) SELECT type, n FROM d ORDER BY n DESC, type")
def q_edge_type_counts(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query("SELECT user_id, count(*) AS mentions, round(avg(coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE value END, 0.5)), 6) AS salience FROM events GROUP BY 1")
def q_salience(s, d):
    e = t(s, d, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return rollup.salience(e, "user_id", "v").select("user_id", "mentions", F.round("salience", 6).alias("salience"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other FROM events GROUP BY 1")
def q_outcomes(s, d):
    return rollup.outcomes(t(s, d, "events"), "user_id", "event_type", ["click", "view"])


@query("SELECT row_number() OVER (ORDER BY x) AS place, 'S' || x AS session FROM (SELECT DISTINCT event_id % 120 AS x FROM events)")
def q_numeric_order(s, d):
    names = t(s, d, "events").select(F.concat(F.lit("S"), (F.col("event_id") % 120).cast("string")).alias("session")).distinct()  # 120 names
    return names.select(F.row_number().over(Window.orderBy(X.numbered_first(F.col("session")), "session")).alias("place"), "session")


@query("SELECT coalesce(nullif(list_position(['view', 'error', 'click'], event_type), 0), 4) AS place, event_type, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY place, n DESC")
def q_fixed_order(s, d):
    counts = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rollup.in_order(counts, "event_type", ["view", "error", "click"], F.desc("n")).select("place", "event_type", "n")


@query(f"WITH {MENTIONS}, g AS (SELECT entity, len(list_distinct(list(session))) AS k FROM m GROUP BY 1) SELECT count(*) AS entities, CAST(sum(k) AS BIGINT) AS sources FROM g")
def q_dataset_totals(s, d):
    g = mentions(s, d).groupBy("entity").agg(F.collect_set("session").alias("x"))
    return g.agg(F.count("*").alias("entities"), F.sum(F.size("x")).alias("sources"))


@query("WITH f AS (SELECT user_id, props, min(struct_pack(ts := ts, event_id := event_id)) AS o FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS r FROM f) SELECT user_id, string_agg(props, ' ' ORDER BY r) AS contexts FROM r WHERE r <= 5 GROUP BY 1")
def q_first_contexts(s, d):
    return rollup.contexts(t(s, d, "events"), "user_id", ["ts", "event_id"], "props").select("user_id", F.array_join("contexts", " ").alias("contexts"))


@query("SELECT conv_id, md5('# Session ' || conv_id || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY 1")
def q_session_markdown(s, d):
    out = rollup.parts_joined(t(s, d, "conversations"), "conv_id", "turn", "text", F.concat(F.lit("# Session "), F.col("conv_id").cast("string")))
    return out.select("conv_id", F.md5("text").alias("text"))


# Graph assembly ------------------------------------------------------------------------------------------------------

ENTITIES = "e AS (SELECT s_suppkey AS node, (['WITNESS', 'TESTIMONY', 'LOCATION'])[CAST(s_suppkey % 3 + 1 AS BIGINT)] AS role, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE [CAST(s_nationkey AS INTEGER), CAST(s_suppkey % 4 AS INTEGER)] END AS sessions FROM supplier)"


def entities(s, d):
    k = F.col("s_suppkey")
    role = F.get(F.array(*map(F.lit, ("WITNESS", "TESTIMONY", "LOCATION"))), (k % 3).cast("int"))
    return t(s, d, "supplier").select(k.alias("node"), role.alias("role"), F.when(k % 5 != 0, F.array(F.col("s_nationkey").cast("int"), (k % 4).cast("int"))).alias("sessions"), "s_name")


@query(f"WITH {ENTITIES} SELECT node AS a, session, CASE role WHEN 'WITNESS' THEN 'TESTIFIED_IN' WHEN 'TESTIMONY' THEN 'RECORDED_IN' ELSE 'MENTIONED_IN' END AS type FROM (SELECT node, role, unnest(sessions) AS session FROM e) WHERE session <> 0")
def q_session_edges(s, d):
    return graph.session_edges(entities(s, d))


@query("SELECT o_orderkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS b, 'TESTIMONY_OF' AS type FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def q_typed_edges(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("w"))
    return graph.typed_edges(o, "o_orderkey", "w", "TESTIMONY_OF", t(s, d, "customer").where("c_custkey % 2 = 0"), "c_custkey")


RULES = [("W", None, "L", 2, "WL"), ("L", 3, "P", 1, "LP"), ("P", 2, "W", 2, "WL")]
MEMBERS = "m AS (SELECT DISTINCT l_orderkey AS session, l_partkey AS node, (['W', 'L', 'P'])[CAST(l_partkey % 3 + 1 AS BIGINT)] AS kind, l_partkey * 7 % 31 AS ord FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY ord, node) AS r FROM m)"


@query(f"WITH {MEMBERS}, p AS (SELECT x.node AS a, y.node AS b, 'WL' AS type, struct_pack(i := 0, s := x.session, ra := x.r, rb := y.r) AS o FROM r x JOIN r y ON x.session = y.session AND x.kind = 'W' AND y.kind = 'L' AND y.r <= 2 UNION ALL SELECT x.node, y.node, 'LP', struct_pack(i := 1, s := x.session, ra := x.r, rb := y.r) FROM r x JOIN r y ON x.session = y.session AND x.kind = 'L' AND x.r <= 3 AND y.kind = 'P' AND y.r <= 1 UNION ALL SELECT x.node, y.node, 'WL', struct_pack(i := 2, s := x.session, ra := x.r, rb := y.r) FROM r x JOIN r y ON x.session = y.session AND x.kind = 'P' AND x.r <= 2 AND y.kind = 'W' AND y.r <= 2) SELECT arg_min(a, o) AS a, arg_min(b, o) AS b, type FROM p WHERE a <> b GROUP BY least(a, b), greatest(a, b), type")
def q_typed_pairs(s, d):
    li = t(s, d, "lineitem")
    kind = F.get(F.array(*map(F.lit, "WLP")), (F.col("l_partkey") % 3).cast("int"))
    m = li.select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("node"), kind.alias("kind"), (F.col("l_partkey") * 7 % 31).alias("ord")).distinct()
    return graph.capped_pairs(m, RULES)


EDGES = "e AS (SELECT l_suppkey AS a, l_partkey % 40 AS b, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"


def edges(s, d):
    return t(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("b"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query(f"WITH {EDGES} SELECT arg_min(a, struct_pack(o := ord, a := a, b := b)) AS a, arg_min(b, struct_pack(o := ord, a := a, b := b)) AS b, type FROM e GROUP BY least(a, b), greatest(a, b), type")
def q_undirected_first(s, d):
    return graph.undirected_first(edges(s, d), "ord")


@query("SELECT DISTINCT x.u AS a, y.u AS b FROM (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, user_id AS u FROM events) x JOIN (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, user_id AS u FROM events) y ON x.h = y.h AND x.u < y.u")
def q_cooccur_once(s, d):
    return graph.cooccurrence(t(s, d, "events").select(F.unix_timestamp(F.date_trunc("hour", "ts")).alias("h"), "user_id"), "h", "user_id").select("a", "b")


@query("SELECT o_orderkey, 'edge_' || (1007 + row_number() OVER (ORDER BY o_orderkey)) AS id FROM orders")
def q_edge_ids(s, d):
    old = s.createDataFrame([("edge_7",), ("edge_1007",), ("edge_x",), ("other_9999",)], "id string")
    return graph.numbered(t(s, d, "orders").select("o_orderkey"), old, ["o_orderkey"])


@query("SELECT x.session AS session, coalesce(c, '') AS clicks, coalesce(v, '') AS views, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 16)) AS session) x LEFT JOIN (SELECT event_id % 13 AS session, array_to_string(list_sort(list_distinct(coalesce(list(user_id) FILTER (event_type = 'click'), []))), ',') AS c, array_to_string(list_sort(list_distinct(coalesce(list(user_id) FILTER (event_type = 'view'), []))), ',') AS v, count(DISTINCT user_id) AS n FROM events GROUP BY 1) g ON x.session = g.session")
def q_session_kinds(s, d):
    e = t(s, d, "events").select((F.col("event_id") % 13).alias("session"), "event_type", "user_id")
    out = graph.by_kind(e, "session", "event_type", "user_id", ["click", "view"], s.range(16).withColumnRenamed("id", "session"))
    return out.select("session", F.array_join("click", ",").alias("clicks"), F.array_join("view", ",").alias("views"), "n")


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT 'date-' || strftime(d, '%Y-%m-%d') AS id, strftime(d, '%-d %B %Y') AS name, strftime(d, '%A') AS day, CAST(d AS VARCHAR) AS first, CAST(d AS VARCHAR) AS last, false AS is_summary FROM d UNION ALL SELECT 'date-range', 'All dates', NULL, CAST(min(d) AS VARCHAR), CAST(max(d) AS VARCHAR), true FROM d")
def q_date_nodes(s, d):
    out = graph.date_nodes(t(s, d, "orders"), "o_orderdate")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query(f"WITH {ENTITIES} SELECT node, array_to_string(CASE WHEN len(coalesce(sessions, [])) > 0 THEN sessions ELSE range(1, 6) END, ',') AS sessions FROM e")
def q_sessions_or_all(s, d):
    return entities(s, d).select("node", F.array_join(graph.or_all(F.col("sessions"), F.sequence(F.lit(1), F.lit(5))), ",").alias("sessions"))


@query(f"WITH {EDGES} SELECT a, b, type, ord FROM e WHERE a % 2 = 0 AND b % 2 = 0 AND a IN (SELECT s_suppkey FROM supplier) AND b IN (SELECT s_suppkey FROM supplier)")
def q_both_ends(s, d):
    return graph.both_ends(edges(s, d), t(s, d, "supplier").where("s_suppkey % 2 = 0").withColumnRenamed("s_suppkey", "node"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'x' || s_suppkey ELSE 'x' || s_suppkey END AS name FROM supplier")
def q_merge_graphs(s, d):
    sup = t(s, d, "supplier").withColumnRenamed("s_suppkey", "id")
    base = sup.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 != 0, F.col("s_name")).alias("name"))
    return graph.merge_graphs(base, sup.select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("name")), "id", ["name"])


@query("SELECT 'merge' AS policy, p_brand, arg_min(p_name, p_partkey) AS p_name, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY 2 UNION ALL SELECT 'first', p_brand, arg_min(p_name, p_partkey), arg_min(p_size, p_partkey) FROM part GROUP BY 2 UNION ALL SELECT 'last', p_brand, arg_max(p_name, p_partkey), arg_max(p_size, p_partkey) FROM part GROUP BY 2")
def q_node_policies(s, d):
    p = t(s, d, "part").select("p_brand", "p_name", "p_partkey", F.col("p_size").cast("long").alias("n"))
    out = [graph.nodes_of(p, k, "p_brand", "p_partkey", "n").select(F.lit(k).alias("policy"), "p_brand", "p_name", "n") for k in ("merge", "first", "last")]
    return out[0].union(out[1]).union(out[2])


# Joins and resolution ------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT n_nationkey AS node, n_name AS name FROM nation), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name WHEN s_suppkey % 3 = 0 THEN lower(n_name) ELSE 'nowhere' END AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, node AS a FROM r JOIN n ON lower(r.a) = lower(n.name)")
def q_ends_by_name(s, d):
    n = t(s, d, "nation")
    k = F.col("s_suppkey")
    r = t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(k, F.when(k % 2 == 0, F.col("n_name")).when(k % 3 == 0, F.lower("n_name")).otherwise("nowhere").alias("a"))
    return resolve.by_name(r, ["a"], n.select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))).select("s_suppkey", "a")


@query(f"WITH {ENTITIES}, x AS (SELECT DISTINCT node, role, unnest(sessions) AS i FROM e) SELECT p.node AS a, q.node AS b, count(*) AS shared FROM x p JOIN x q ON p.i = q.i WHERE p.role = 'WITNESS' AND q.role <> 'WITNESS' GROUP BY 1, 2")
def q_shared_sessions(s, d):
    e = entities(s, d)
    return resolve.overlapping(e.where("role = 'WITNESS'").withColumnRenamed("node", "a"), e.where("role <> 'WITNESS'").withColumnRenamed("node", "b"), "a", "b", "sessions")


@query(f"WITH {ENTITIES} SELECT n_nationkey AS session, node FROM nation JOIN e ON list_contains(sessions, CAST(n_nationkey AS INTEGER))")
def q_sessions_holding(s, d):
    keys = t(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("session"))
    return resolve.holding(entities(s, d), keys, "sessions", "session").select(F.col("session").cast("long").alias("session"), "node")


@query(f"WITH {ENTITIES}, v AS (SELECT o_orderkey % 6 AS session, o_orderkey AS video, o_custkey % 9 AS vid FROM orders), m AS (SELECT node, vid, video, session FROM (SELECT DISTINCT node, unnest(sessions) AS session FROM e) JOIN v USING (session)) SELECT node, vid, min(video) AS video FROM m GROUP BY 1, 2")
def q_first_videos(s, d):
    v = t(s, d, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("session"), F.col("o_orderkey").alias("video"), (F.col("o_custkey") % 9).alias("vid"))
    return resolve.first_of(entities(s, d).select("node", F.array_distinct("sessions").alias("sessions")), F.col("sessions"), v, "session", ["video"], "vid").select("node", "vid", "video")


@query("SELECT c_custkey, max(s_suppkey) AS image FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 15 GROUP BY 1")
def q_by_name_key(s, d):
    c = t(s, d, "customer").select("c_custkey", F.concat(F.lit("Dr. N"), (F.col("c_custkey") % 15).cast("string")).alias("name"))
    i = t(s, d, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("other"), F.col("s_suppkey").alias("image"))
    return resolve.by_key(c, i, X.name_key, "name", "other", "image", "image").select("c_custkey", "image")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'WITNESS' WHEN s_nationkey % 2 = 0 THEN 'KEY_FIGURE' ELSE 'PERSON' END AS kind FROM supplier")
def q_enriched(s, d):
    n = t(s, d, "nation")
    m = t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("name"), F.lit("PERSON").alias("typed"))
    tables = [(n.where("n_nationkey % 3 = 0"), "n_name", "WITNESS"), (n.where("n_nationkey % 2 = 0"), "n_name", "KEY_FIGURE")]
    return resolve.enriched(m, "name", tables, "typed").select("s_suppkey", "kind")


@query("SELECT o_orderkey AS file, unnest(range(o_orderkey % 7, o_orderkey % 11 + 1)) AS session FROM orders")
def q_file_sessions(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 7).alias("a"), (F.col("o_orderkey") % 11).alias("b"))
    return resolve.file_sessions(o, "a", "b").select("file", "session")


PEOPLE = [(0, "Anna Bern", ["a. bern", "bern", "anna b. bern"]), (1, "Carl Dunn", ["dunn", "carl dunn"]), (2, "Karla Dunn", ["dunn", "karlchen dunn"]), (3, "Emil Goldberg", ["goldberg"]), (4, "Emilia Ilk", ["ilk"]), (5, "Otto Stern", ["stern", "red otto"])]
ASKED = [("anna bern", 0, 1), ("A. Bern", 0, 2), ("Dr Bern", 0, 3), ("X Dunn", None, None), ("Carl X Dunn", 1, 4), ("Karlchen von Dunn", 2, 4), ("Frau Goldberg", 3, 3), ("Emil Ilk", 4, 4), ("Mr Ilk", None, None), ("nobody", None, None), ("Red Otto", 5, 2), ("Karla Maria Dunn", 2, 4), ("", None, None), (None, None, None)]


def people(s):
    return s.createDataFrame(PEOPLE, "ord int, name string, terms array<string>")


@query(f"SELECT query, ord, tier FROM {values(ASKED, 'query, ord, tier')} WHERE ord IS NOT NULL")
def q_strict_cascade(s, d):
    return resolve.strict_cascade(s.createDataFrame([(q,) for q, _, _ in ASKED], "query string"), people(s))


FOUND = [("CARL DUNN", 1, 1), ("dunn", 1, 2), ("emil", 3, 3), ("otto", 5, 3), ("karlchen", 2, 4), ("zed", None, None), ("bern", 0, 2)]


@query(f"SELECT query, ord, tier FROM {values(FOUND, 'query, ord, tier')} WHERE ord IS NOT NULL")
def q_exact_then_inside(s, d):
    return resolve.contained_cascade(s.createDataFrame([(q,) for q, _, _ in FOUND], "query string"), people(s), resolve.exact_then_inside(["name"], "terms"))


@query("SELECT n_name AS query, i.ord AS ord, CASE WHEN lower(n_name) = lower(i.name) THEN 1 ELSE 3 END AS tier FROM nation JOIN (SELECT r_regionkey AS ord, r_name AS name FROM region) i ON lower(n_name) = lower(i.name) OR contains(lower(n_name), lower(i.name)) OR contains(lower(i.name), lower(n_name)) QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY i.ord) = 1 UNION ALL SELECT 'East ' || r_name, r_regionkey, CASE WHEN contains(r_name, ' ') THEN 2 ELSE 2 END FROM region")
def q_mutual_containment(s, d):
    q = t(s, d, "nation").select(F.col("n_name").alias("query")).union(t(s, d, "region").select(F.concat(F.lit("East "), "r_name")))
    return resolve.contained_cascade(q, t(s, d, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name")), resolve.mutual(), by_index=True)


@query("SELECT user_id, arg_min(event_id, struct_pack(t := k, e := event_id)) AS ord, min(k) AS tier FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 3 END AS k FROM events) GROUP BY 1")
def q_best_file(s, d):
    return resolve.best_file(t(s, d, "events"), "user_id", "event_id", [F.col("event_type") == "purchase", F.col("event_type") == "signup"])


@query("SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_concat([s_name, 'a'], CASE WHEN s_suppkey % 2 = 0 THEN ['b', 'a', 'B' || s_suppkey] ELSE [] END))), ',') AS variants FROM supplier")
def q_more_variants(s, d):
    sup = t(s, d, "supplier").select("s_suppkey", F.array("s_name", F.lit("a")).alias("variants"))
    more = t(s, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.array(F.lit("b"), F.lit("a"), F.concat(F.lit("B"), F.col("s_suppkey").cast("string"))).alias("variants"))
    return resolve.more_variants(sup, more, "s_suppkey", "variants").select("s_suppkey", F.array_join("variants", ",").alias("variants"))


# Filters, searches and orders ----------------------------------------------------------------------------------------

LEAST = {"click": 200, "view": 300, "error": 10, "signup": 10**6}


@query("SELECT CASE WHEN event_type = 'error' THEN 'ISSUE' ELSE event_type END AS kind, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def q_type_rewrite(s, d):
    e = t(s, d, "events").where(F.col("event_type") != "view")
    return e.groupBy(F.when(F.col("event_type") == "error", "ISSUE").otherwise(F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), 'supplier#') OR contains(s_name, 'X') UNION ALL SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '') AND s_suppkey % 2 = 0")
def q_search_two_names(s, d):
    sup = t(s, d, "supplier")
    both = lambda q: F.contains(F.lower("s_name"), F.lit(q.lower())) | F.contains("s_name", F.lit(q))
    return sup.where(both("Supplier#")).select("s_suppkey").union(sup.where(both("")).where("s_suppkey % 2 = 0").select("s_suppkey"))


@query("SELECT source, count(*) FILTER (starts_with(lower(source), 'src1')) AS main, count(*) FILTER (NOT starts_with(lower(source), 'src1')) AS other FROM documents GROUP BY 1")
def q_category_split(s, d):
    main = F.startswith(F.lower("source"), F.lit("src1"))
    return t(s, d, "documents").groupBy("source").agg(F.count(F.when(main, 1)).alias("main"), F.count(F.when(~main, 1)).alias("other"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND event_id % 13 IN (1, 5, 6)")
def q_active_types(s, d):
    phase = s.createDataFrame([([1, 5, 6],)], "sessions array<long>").select(F.explode("sessions").alias("k"))
    e = t(s, d, "events").where(F.col("event_type").isin("click", "error")).withColumn("k", F.col("event_id") % 13)
    return e.join(F.broadcast(phase), "k", "left_semi").select("event_id")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 1 ELSE 4 END")
def q_type_thresholds(s, d):
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in {"click": 3, "view": 2, "error": 1}.items() for x in kv])[F.col("event_type")], F.lit(4))
    return t(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


@query("SELECT n_nationkey FROM nation WHERE replace(lower(n_name), ' ', '_') IN (SELECT lower(replace(n_name, ' ', '_')) FROM nation WHERE n_nationkey % 3 = 0)")
def q_loose_key(s, d):
    n = t(s, d, "nation")
    key = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    asked = n.where("n_nationkey % 3 = 0").select(F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("q"))
    return n.join(asked.select(key("q").alias("k")).distinct(), key("n_name") == F.col("k"), "left_semi").select("n_nationkey")


@query("SELECT s_suppkey FROM supplier WHERE CAST(s_suppkey AS VARCHAR) = 'supplier#000000004' OR s_name = 'supplier#000000004' OR lower(s_name) = 'supplier#000000004' ORDER BY s_suppkey LIMIT 1")
def q_lookup(s, d):
    q = "supplier#000000004"
    sup = t(s, d, "supplier")
    return graph.top(sup.where((F.col("s_suppkey").cast("string") == q) | (F.col("s_name") == q) | (F.lower("s_name") == q)), 1, "s_suppkey").select("s_suppkey")


@query("SELECT s_suppkey, array_to_string(list_filter([1, 2, 3], lambda x: x <> s_suppkey % 3 + 1), ',') || CASE WHEN s_suppkey % 3 = 1 THEN '' ELSE ',9' END AS sessions FROM supplier")
def q_array_fixes(s, d):
    k = F.col("s_suppkey")
    a = F.array_remove(F.array(*map(F.lit, (1, 2, 3))), (k % 3 + 1).cast("int"))
    return t(s, d, "supplier").select(k, F.array_join(F.when(k % 3 == 1, a).otherwise(F.array_union(a, F.array(F.lit(9)))), ",").alias("sessions"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 100, 'NEW'")
def q_insert_absent(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    more = s.createDataFrame([(1, "KNOWN"), (100, "NEW")], "id long, name string")
    return n.unionByName(more.join(n, "id", "left_anti"))


@query("SELECT doc_id, line_no FROM (SELECT doc_id, unnest(range(len(p))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE line_no BETWEEN 2 AND 6")
def q_line_page(s, d):
    from ..operators import segment

    return segment.lines(t(s, d, "documents")).where("line_no between 2 and 6").select("doc_id", "line_no")


@query("SELECT c_name FROM customer ORDER BY c_name LIMIT 50")
def q_name_order(s, d):
    """Binary order: the same everywhere, whatever the locale."""
    return graph.top(t(s, d, "customer").select("c_name"), 50, "c_name")


@query()
def q_random_six(s, d):
    """Six rows in an order that a seed fixes."""
    return t(s, d, "customer").orderBy(F.xxhash64("c_custkey", F.lit(42)), "c_custkey").limit(6).select("c_custkey")


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_id)))[1:10], ',') AS first FROM events GROUP BY 1")
def q_first_sources(s, d):
    e = t(s, d, "events").withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("_r <= 10")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_id")), ",").alias("first"))


@query("SELECT unnest(['PERSON', 'PLACE']) AS type, unnest([(SELECT count(*) FROM nation), (SELECT count(*) FROM region)]) AS n, unnest([0, (SELECT count(*) FROM region)]) AS extra")
def q_typed_union(s, d):
    a = t(s, d, "nation").select(F.lit("PERSON").alias("type"), F.col("n_name").alias("name"))
    b = t(s, d, "region").select(F.lit("PLACE").alias("type"), F.col("r_name").alias("name"), F.lit(1).alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("type").agg(F.count("*").alias("n"), F.count("extra").alias("extra"))


@query(f"WITH {ENTITIES} SELECT node, array_to_string(list_sort(list_distinct(list_concat(coalesce(sessions, []), [2, 3]))), ',') AS a, len(list_filter([2, 3], lambda x: list_contains(coalesce(sessions, []), x))) AS n, list_has_any(coalesce(sessions, []), [2, 3]) AS any FROM e")
def q_array_sets(s, d):
    x = F.coalesce("sessions", F.array().cast("array<int>"))
    two = F.array(F.lit(2), F.lit(3))
    return entities(s, d).select("node", F.array_join(F.array_sort(F.array_union(x, two)), ",").alias("a"), F.size(F.array_intersect(two, x)).alias("n"), F.arrays_overlap(x, two).alias("any"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, strftime(CAST(o_orderdate AS DATE), '%A') AS weekday, CAST(date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) AS INTEGER) + 1 AS trial_day, count(*) AS n FROM orders GROUP BY ALL")
def q_trial_days(s, d):
    o = t(s, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    first = o.agg(F.min("day").alias("first"))  # one row
    days = o.groupBy("day").agg(F.count("*").alias("n")).crossJoin(F.broadcast(first))
    return days.select(F.col("day").cast("string").alias("day"), F.date_format("day", "EEEE").alias("weekday"), (F.datediff("day", "first") + 1).alias("trial_day"), "n")


@query("SELECT user_id, CAST(to_json(struct_pack(user_id := user_id, n := count(*))) AS VARCHAR) AS js FROM events GROUP BY 1")
def q_json_out(s, d):
    g = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.to_json(F.struct("user_id", "n")).alias("js"))


@query("SELECT w AS token, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) GROUP BY 1")
def x_inverted_index(s, d):
    """Extension: a token index by documents."""
    words = t(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), 1))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("SELECT vec_id, round(c, 6) AS cosine FROM (SELECT v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings v WHERE v.vec_id <> 0) ORDER BY c DESC, vec_id LIMIT 10")
def x_cosine_topk(s, d):
    """Extension: the ten vectors most like one of them, one scan."""
    v = t(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = v.where("vec_id = 0").select(F.col("e").alias("q"))  # one row
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    c = dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q")))
    return v.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", c.alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.round("c", 6).alias("cosine"))
