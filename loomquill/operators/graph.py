"""Nodes, edges, co-occurrence, degrees and neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Nodes of a group up to which its pairs are made by a join; so many smaller groups may go with the larger ones.
SMALL_GROUP, FEW_GROUPS = 64, 10_000
#: The most nodes of a block: a task counts the pairs of two blocks in one table.
BLOCK = 4096


def cooccurrence(members: DataFrame, group: str, node: str) -> DataFrame:
    """(a, b, weight), a < b: unordered pairs by the number of groups that hold both.

    Pairs of small groups come from an equi-join on the group. Those of larger groups, of which there are far more than
    members, are counted where they are made: nodes are dealt into blocks, and a task counts two blocks' pairs over all groups.
    """
    m = members.select(F.col(group).alias("g"), F.col(node).alias("node")).where("g is not null and node is not null").distinct()
    sizes = m.groupBy("g").agg(F.count("*").alias("n"))
    few, many = sizes.agg(F.count_if(F.col("n") <= SMALL_GROUP), F.count_if(F.col("n") > SMALL_GROUP)).first()
    if many and few <= FEW_GROUPS:
        return _counted_by_blocks(m)
    small = m.join(sizes.where(F.col("n") <= SMALL_GROUP).select("g"), "g", "left_semi") if many else m
    pairs = small.withColumnRenamed("node", "a").join(small.withColumnRenamed("node", "b"), "g").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))
    if not many:
        return pairs
    large = _counted_by_blocks(m.join(sizes.where(F.col("n") > SMALL_GROUP).select("g"), "g", "left_semi"))
    return pairs.union(large).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _counted_by_blocks(m: DataFrame) -> DataFrame:
    """(a, b, weight) of members (g, node), each once. What is shuffled grows with the members and the blocks, not with the pairs."""
    spark, kind = m.sparkSession, m.schema["node"].dataType
    nodes = m.select("node").distinct()
    n = nodes.count()
    blocks = max(-(-n // (BLOCK // 2)), min(8, -(-n // 128)))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    lists = nodes.groupBy(block.alias("b")).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    places = lists.select("b", F.posexplode("nodes").alias("at", "node")).select("b", F.col("at").cast("short").alias("at"), "node")
    part = m.join(places, "node").groupBy("g", "b").agg(F.collect_list("at").alias("at"))
    part = part.groupBy("g").agg(F.collect_list(F.struct("b", "at")).alias("parts"))
    met = part.select(F.explode("parts").alias("x"), "parts").select("x", F.explode(F.filter("parts", lambda y: y["b"] >= F.col("x.b"))).alias("y"))
    none = lambda t: F.lit(None).cast(t)
    met = met.select(F.col("x.b").alias("i"), F.col("y.b").alias("j"), F.col("x.at").alias("x"), F.col("y.at").alias("y"), none(T.ArrayType(kind)).alias("left"), none(T.ArrayType(kind)).alias("right"))
    # each pair of blocks has its nodes in a row that comes first
    two = lists.select(F.col("b").alias("i"), F.col("nodes").alias("left")).join(lists.select(F.col("b").alias("j"), F.col("nodes").alias("right")), F.col("i") <= F.col("j"))
    named = two.select("i", "j", none("array<short>").alias("x"), none("array<short>").alias("y"), "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = right = table = own = None
        for b in batches:
            i, j = (b.column(k).to_numpy() for k in (0, 1))
            for r in range(b.num_rows):
                if b.column(4)[r].is_valid:
                    if table is not None:
                        yield from pairs(table, left, right, own)
                    left, right, own = b.column(4)[r].values, b.column(5)[r].values, i[r] == j[r]
                    table = np.zeros((len(left), len(right)), np.int32)
                else:
                    x, y = (b.column(k)[r].values.to_numpy() for k in (2, 3))
                    table[x[:, None], y] += 1
        if table is not None:
            yield from pairs(table, left, right, own)

    def pairs(table: np.ndarray, left: pa.Array, right: pa.Array, own: bool) -> Iterator[pa.RecordBatch]:
        if own:
            table = np.triu(table, 1)
        for at in range(0, len(left), 64):
            x, y = np.nonzero(table[at : at + 64])
            if len(x):
                yield pa.RecordBatch.from_arrays([left.take(pa.array(x + at)), right.take(pa.array(y)), pa.array(table[at : at + 64][x, y].astype(np.int64))], ["a", "b", "weight"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = named.union(met).repartition(tasks, "i", "j").sortWithinPartitions("i", "j", F.col("left").isNull())
    out = dealt.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("weight", T.LongType())]))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def capped(members: DataFrame, group: str, node: str, order: list, cap: int) -> DataFrame:
    """The first `cap` nodes of each group; the cap is the operator's feature."""
    w = Window.partitionBy(group).orderBy(*order, node)
    return members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, degree): a loop counts twice; with a weight its sum."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), *([F.col(weight)] if weight else []))
    return ends.groupBy("node").agg((F.sum(weight) if weight else F.count("*")).alias("degree"))


def node_sizes(d: DataFrame, least: float = 15, span: float = 55) -> DataFrame:
    top = d.agg(F.max("degree").alias("top"))  # one row
    return d.crossJoin(F.broadcast(top)).select("node", "degree", F.round(least + F.log(F.col("degree") + 1) / F.log(F.col("top") + 1) * span, 6).alias("size"))


def redirect(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(a, b) with both ends sent through merged (old, new), one hop, each pair once; loops may come out."""
    m = lambda c: merged.select(F.col("old").alias(c), F.col("new").alias("_" + c))
    e = edges.select("a", "b").join(m("a"), "a", "left").join(m("b"), "b", "left")
    return e.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(node, weight): one hop in both directions."""
    out = edges.where(F.col("a") == node).select(F.col("b").alias("node"), "weight")
    return out.union(edges.where(F.col("b") == node).select(F.col("a").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("weight"))


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def spine(keys: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Every key with its count, 0 where nothing was seen."""
    return keys.join(facts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def padded_links(keys: DataFrame, members: DataFrame, entities: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(key, node, type, edge, weight): up to limits[type] entities of each type for every key.

    keys (key, session) and members (node, session) say who shares a session: those come first, in the order of
    entities (node, type, ord). What is missing is filled up with the first of the type, linked already or not.
    A session's first few of each type are found once, so a key meets these and not all who share its session.
    """
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    typed = entities.where(F.col("type").isin(*limits))
    most = max([0, *limits.values()])

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        """The first few of each type; the fixed bound lets Spark cut before it shuffles."""
        out = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "type").orderBy("ord", "node", "_i")))
        return out.where(F.col("_r") <= most).where(F.col("_r") <= limit[F.col("type")])

    # _i tells equal rows of entities apart; a node that a key meets in two sessions is one
    typed = typed.groupBy("node", "type", "ord").agg(F.count("*").alias("_c")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.least("_c", F.lit(max(1, most)))))).drop("_c")
    heads = ranked(members.select("node", "session").distinct().join(typed, "node"), "session").drop("_r")
    near = ranked(keys.join(heads, "session").drop("session").distinct(), "key")
    first = ranked(typed)
    every = keys.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, limits))).alias("type"))
    have = near.groupBy("key", "type").agg(F.count("*").alias("_n"))
    # first has as many rows as the limits add up to
    pad = every.join(have, ["key", "type"], "left").join(F.broadcast(first), "type").where(F.col("_r") <= limit[F.col("type")] - F.coalesce("_n", F.lit(0)))
    return near.select("key", "node", "type", F.lit("MENTIONED_IN").alias("edge"), F.lit(2).alias("weight")).union(pad.select("key", "node", "type", F.lit("RELATED_TO"), F.lit(1)))


def linked_nodes(edges: DataFrame, node, sessions: DataFrame, nodes: DataFrame, k: int = 30) -> DataFrame:
    """The k most mentioned of nodes (node, mentions, hidden) that edges (a, b, type) tie to a node or to its sessions (session)."""
    direct = edges.where(F.col("a") == node).select(F.col("b").alias("node")).union(edges.where(F.col("b") == node).select(F.col("a").alias("node")))
    shared = edges.where("type = 'MENTIONED_IN'").join(sessions.select(F.col("session").alias("b")).distinct(), "b", "left_semi").select(F.col("a").alias("node"))
    return top(nodes.where("not hidden").join(direct.union(shared).distinct(), "node", "left_semi"), k, F.desc("mentions"), "node")


def session_edges(entities: DataFrame) -> DataFrame:
    """(a, session, type): entities (node, role, sessions) tied to each of their sessions by role; null and 0 are no sessions."""
    kind = F.when(F.col("role") == "WITNESS", "TESTIFIED_IN").when(F.col("role") == "TESTIMONY", "RECORDED_IN").otherwise("MENTIONED_IN")
    return entities.select(F.col("node").alias("a"), F.explode("sessions").alias("session"), kind.alias("type")).where("session <> 0")


def typed_edges(rows: DataFrame, a: str, b: str, kind: str, among: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(a, b, type) where both ends are there; with `among`, only those whose b is one of its keys."""
    out = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).alias("type"))
    return out.join(among.select(F.col(key).alias("b")).distinct(), "b", "left_semi").select("a", "b", "type") if among is not None else out


def capped_pairs(members: DataFrame, rules: list[tuple[str, int | None, str, int | None, str]]) -> DataFrame:
    """(a, b, type) from members (session, node, kind, ord): the first few of two kinds in a session are paired.

    rules: (kind of a, cap or None, kind of b, cap or None, type). Undirected duplicates go, the first direction by
    (rule, session, order) stays. Caps bound what a session pairs; a rule without caps on both sides pairs all.
    """
    w = Window.partitionBy("session", "kind").orderBy("ord", "node")
    ranked = members.withColumn("_r", F.row_number().over(w))
    found = None
    for i, (ka, ca, kb, cb, kind) in enumerate(rules):
        side = lambda k, c, n: ranked.where(F.col("kind") == k).where(F.lit(True) if c is None else F.col("_r") <= c).select("session", F.col("node").alias(n), F.col("_r").alias("_" + n))
        pairs = side(ka, ca, "a").join(side(kb, cb, "b"), "session").where("a <> b").select("a", "b", F.lit(kind).alias("type"), F.struct(F.lit(i).alias("i"), "session", "_a", "_b").alias("_o"))
        found = pairs if found is None else found.union(pairs)
    return found.groupBy(F.least("a", "b"), F.greatest("a", "b"), "type").agg(F.min_by(F.struct("a", "b"), "_o").alias("e")).select("e.a", "e.b", "type")


def undirected_first(edges: DataFrame, order: str) -> DataFrame:
    """One edge (a, b, type) of each unordered pair and type, the first by order."""
    first = F.min_by(F.struct("a", "b"), F.struct(order, "a", "b"))
    return edges.groupBy(F.least("a", "b"), F.greatest("a", "b"), "type").agg(first.alias("e")).select("e.a", "e.b", "type")


def _not_after(order: list[str], bound: Row) -> Column:
    """Whether a row stands at or before the bound, nulls last."""
    out = F.lit(True)
    for c, v in reversed([(F.col(c), bound[i]) for i, c in enumerate(order)]):
        out = c.isNotNull() | out if v is None else F.when(c < F.lit(v), True).when(c == F.lit(v), out).otherwise(False)
    return out


def _range_of(order: list[str], bounds: list[Row], first: int = 0) -> Column:
    """The place of a row among sorted bounds, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(_not_after(order, bounds[mid]), _range_of(order, bounds[:mid], first)).otherwise(_range_of(order, bounds[mid + 1 :], first + mid + 1))


def numbered(new: DataFrame, edges: DataFrame, order: list[str], prefix: str = "edge_") -> DataFrame:
    """new with ids that go on from the greatest number of the ids that edges have, nulls of the order last. New edges are
    numbered in ranges: each range's first number comes from the counts of those before it, so no task holds all of them.

    The ranges' bounds are values, so a row is in the same range however often the plan runs; only where the bounds
    lie comes from a sample.
    """
    last = edges.agg(F.coalesce(F.max(F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("m")).first().m
    ranges = min(1024, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = [F.col(c).asc_nulls_last() for c in order]
    sample = new.select(*order).sample(min(1.0, 50 * ranges / max(1, new.count())), 42).orderBy(*ordered).collect()  # about 50 a range
    bounds = [sample[at] for at in sorted({len(sample) * i // ranges for i in range(1, ranges)})] if sample else []
    ranged = new.withColumn("_p", _range_of(order, bounds))
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # a number a range
    before, at = {}, last
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    base = F.create_map(*[x for p, n in (before or {0: last}).items() for x in (F.lit(p), F.lit(n).cast("long"))])
    number = base[F.col("_p")] + F.row_number().over(Window.partitionBy("_p").orderBy(*ordered))
    return ranged.withColumn("id", F.concat(F.lit(prefix), number.cast("string"))).drop("_p")


def by_kind(rows: DataFrame, session: str, kind: str, node: str, kinds: list[str], spine: DataFrame | None = None) -> DataFrame:
    """(session, one sorted array of nodes a kind, n): every session of the spine, empty where nothing was seen."""
    lists = [F.array_sort(F.collect_set(F.when(F.col(kind) == k, F.col(node)))).alias(k) for k in kinds]
    out = rows.groupBy(session).agg(*lists, F.countDistinct(node).alias("n"))
    if spine is None:
        return out
    empty = [F.coalesce(k, F.array().cast(out.schema[k].dataType)).alias(k) for k in kinds]
    return spine.select(session).distinct().join(out, session, "left").select(session, *empty, F.coalesce("n", F.lit(0)).alias("n"))


def date_nodes(rows: DataFrame, date: str) -> DataFrame:
    """(id, name, day, first, last, is_summary): a node for each date, and one row for the whole span."""
    days = rows.select(F.to_date(date).alias("d")).where("d is not null").distinct()
    one = days.select(F.date_format("d", "'date-'yyyy-MM-dd").alias("id"), F.date_format("d", "d MMMM yyyy").alias("name"), F.date_format("d", "EEEE").alias("day"), F.col("d").alias("first"), F.col("d").alias("last"), F.lit(False).alias("is_summary"))
    span = days.agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first is not null")
    return one.union(span.select(F.lit("date-range"), F.lit("All dates"), F.lit(None).cast("string"), "first", "last", F.lit(True)))


def or_all(sessions: Column, every: Column) -> Column:
    """A node's sessions, or all of them where none was found."""
    return F.when(F.size(F.coalesce(sessions, F.array().cast("array<int>"))) > 0, sessions).otherwise(every)


def both_ends(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges whose two ends are among the nodes."""
    n = nodes.select(node).distinct()
    return edges.join(n.withColumnRenamed(node, "a"), "a", "left_semi").join(n.withColumnRenamed(node, "b"), "b", "left_semi").select(*edges.columns)


def merge_graphs(base: DataFrame, other: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """base's rows, with the filled columns from other where base has none, and other's rows whose key base lacks; both have a key once."""
    o = other.select(key, *[F.col(c).alias("_" + c) for c in fill])
    kept = base.join(o, key, "left").withColumns({c: F.coalesce(c, "_" + c) for c in fill}).select(*base.columns)
    return kept.unionByName(other.join(base.select(key), key, "left_anti").select(*base.columns))


def nodes_of(rows: DataFrame, on_collision: str, key: str, order: str, count: str) -> DataFrame:
    """One node a key: `merge` sums counts, `first` keeps the first row by order, `last` the last one."""
    pick = {"merge": F.min_by, "first": F.min_by, "last": F.max_by}[on_collision]
    fields = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(pick(F.struct(*fields), F.col(order)).alias("_x"), F.sum(count).alias("_n")).select(key, "_x.*", "_n")
    return out.withColumn(count, F.col("_n")).drop("_n") if on_collision == "merge" else out.drop("_n")
