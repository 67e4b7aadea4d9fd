"""Entity resolution: merge by key, canonical maps, tiered cascades, variant terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_by_key(rows: DataFrame, key: Column, name: str, order: str, count: str) -> DataFrame:
    """(key, name, mentions, n_names): sums, and the longest display name, the first of equals."""
    best = F.min_by(F.col(name), F.struct(-F.length(name), F.col(order), F.col(name)))
    return rows.groupBy(key.alias("key")).agg(best.alias("name"), F.sum(count).alias("mentions"), F.countDistinct(name).alias("n_names"))


def apply_map(rows: DataFrame, mapping: DataFrame, name: str, keep_unmapped: bool = False) -> DataFrame:
    """rows with `canonical`; names that are neither variant nor canonical go, unless kept."""
    m = mapping.groupBy(F.lower("variant").alias("_k")).agg(F.max("canonical").alias("canonical"))
    known = mapping.select(F.col("canonical").alias("_c")).distinct()
    out = rows.withColumn("_k", F.lower(name)).join(m, "_k", "left").join(known, rows[name] == F.col("_c"), "left")
    out = out.withColumn("canonical", F.coalesce("canonical", "_c", *([F.col(name)] if keep_unmapped else []))).drop("_k", "_c")
    return out.where("canonical is not null")


def variants(name: Column, least: int = 3) -> Column:
    """Search terms of a name: whole, last part, without hyphens, without its title."""
    plain = F.trim(F.regexp_replace(name, "(?i)^(dr|prof|judge)\\.? ", ""))
    every = F.array(name, F.try_element_at(F.split(name, " "), F.lit(-1)), F.replace(name, F.lit("-"), F.lit(" ")), plain)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) >= least)))


def cascade(queries: DataFrame, index: DataFrame, by_index: bool = False) -> DataFrame:
    """(query, ord, tier): the best canonical of each query by exact name (1), key (2) or last word, if unique (3).

    Tiers come before index order, or with by_index behind it. Each tier is an equi-join.
    """
    q = queries.select("query").distinct().withColumns({"k2": F.lower(F.trim("query")), "k3": F.lower(F.try_element_at(F.split(F.trim("query"), " "), F.lit(-1)))})
    i = index.select("ord", "name").withColumns({"k2": F.lower(F.trim("name")), "k3": F.lower(F.try_element_at(F.split(F.trim("name"), " "), F.lit(-1)))})
    single = i.groupBy("k3").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n = 1").select("k3", "ord")
    hits = q.join(i, q["query"] == i["name"]).select("query", "ord", F.lit(1).alias("tier"))
    hits = hits.union(q.join(i.select("k2", "ord"), "k2").select("query", "ord", F.lit(2)))
    hits = hits.union(q.join(single, "k3").select("query", "ord", F.lit(3)))
    order = F.struct("ord", "tier") if by_index else F.struct("tier", "ord")
    return hits.groupBy("query").agg(F.min(order).alias("x")).select("query", "x.ord", "x.tier")


def set_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(both, only_left, only_right): sizes of the overlap and the differences."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("in_both"), F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"))


def merge_cross_type(orgs: DataFrame, locations: DataFrame, places: DataFrame, persons: DataFrame) -> DataFrame:
    """(kind, ord, name, mentions, sessions) of both kinds; inputs have ord, name, key, mentions, sessions, the last two a key.

    An organization whose key is a location's or a known place's goes, and the first location of that key takes its
    mentions and sessions; one that is a known person goes without.
    """
    taken = locations.select("key").union(places.select("key")).distinct()
    moved = orgs.join(taken, "key", "left_semi").groupBy("key").agg(F.sum("mentions").alias("_m"), F.array_distinct(F.flatten(F.collect_list("sessions"))).alias("_s"))
    heads = locations.groupBy("key").agg(F.min("ord").alias("ord"))
    more = heads.join(moved, "key").select("ord", "_m", "_s")
    grown = locations.join(more, "ord", "left").select(F.lit("location").alias("kind"), "ord", "name", (F.col("mentions") + F.coalesce("_m", F.lit(0))).alias("mentions"), F.coalesce(F.array_union("sessions", "_s"), "sessions").alias("sessions"))
    left = orgs.join(taken, "key", "left_anti").join(persons.select("key").distinct(), "key", "left_anti")
    return grown.union(left.select(F.lit("organization"), "ord", "name", "mentions", "sessions"))


def merge_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(idx, name, mentions, n_members) after merging rows (idx, name, mentions) by groups (grp, pos, idx).

    An index stays in the first group that names it; a group goes by its first member left; the rest stand alone.
    """
    first = groups.groupBy("idx").agg(F.min(F.struct("grp", "pos")).alias("_g"))
    placed = rows.join(first, "idx", "left").withColumn("_key", F.struct(F.col("_g").isNull().alias("alone"), F.coalesce(F.col("_g.grp").cast("long"), F.col("idx").cast("long")).alias("id")))
    base = F.min_by(F.struct("idx", "name"), F.struct("_g.pos", "idx"))
    return placed.groupBy("_key").agg(base.alias("_b"), F.sum("mentions").alias("mentions"), F.count("*").alias("n_members")).select("_b.idx", "_b.name", "mentions", "n_members")


def by_name(rows: DataFrame, ends: list[str], nodes: DataFrame) -> DataFrame:
    """rows whose ends name a node of nodes (node, name, ord), exactly or in lower case; the last node of a name counts.

    Each end gives way to its node; rows with an end that names none go.
    """
    exact = nodes.groupBy("name").agg(F.max_by("node", "ord").alias("_x"))
    lower = nodes.groupBy(F.lower("name").alias("_k")).agg(F.max_by("node", "ord").alias("_y"))
    for e in ends:
        rows = rows.join(exact.withColumnRenamed("name", e), e, "left").withColumn("_k", F.lower(e)).join(lower, "_k", "left")
        rows = rows.withColumn(e, F.coalesce("_x", "_y")).where(F.col(e).isNotNull()).drop("_k", "_x", "_y")
    return rows


def overlapping(a: DataFrame, b: DataFrame, key_a: str, key_b: str, items: str) -> DataFrame:
    """(key_a, key_b, shared): pairs whose arrays share an item, by how many; an equi-join on items, never all pairs."""
    x = a.select(key_a, F.explode(F.array_distinct(items)).alias("_i"))
    y = b.select(key_b, F.explode(F.array_distinct(items)).alias("_i"))
    return x.join(y, "_i").groupBy(key_a, key_b).agg(F.count("*").alias("shared"))


def holding(rows: DataFrame, keys: DataFrame, items: str, item: str) -> DataFrame:
    """keys with the rows whose array holds them; an equi-join."""
    return rows.withColumn(item, F.explode(F.array_distinct(items))).join(keys, item)


def by_key(rows: DataFrame, other: DataFrame, key, name: str, other_name: str, value: str, order: str) -> DataFrame:
    """rows with other's value for the same key of the name, null where there is none; the last of other's rows counts."""
    o = other.groupBy(key(F.col(other_name)).alias("_k")).agg(F.max_by(value, order).alias(value))
    return rows.withColumn("_k", key(F.col(name))).join(o, "_k", "left").drop("_k")


def enriched(mentions: DataFrame, name: str, tables: list[tuple[DataFrame, str, str]], otherwise: str) -> DataFrame:
    """mentions with `kind`: the first of tables (rows, name column, kind) that has the name in any case, else the column `otherwise`."""
    kinds = []
    for i, (rows, column, kind) in enumerate(tables):
        known = rows.select(F.lower(column).alias("_k")).where("_k is not null").distinct().withColumn(f"_t{i}", F.lit(kind))
        mentions = mentions.withColumn("_k", F.lower(name)).join(known, "_k", "left").drop("_k")
        kinds.append(f"_t{i}")
    return mentions.withColumn("kind", F.coalesce(*kinds, otherwise)).drop(*kinds)


def file_sessions(files: DataFrame, start: str, end: str) -> DataFrame:
    """files with a row for each session of their range; reversed or null ranges give none."""
    return files.where(F.col(start) <= F.col(end)).withColumn("session", F.explode(F.sequence(start, end)))


def first_of(rows: DataFrame, keys: Column, other: DataFrame, key: str, order: list[str], distinct: str) -> DataFrame:
    """rows with other's first rows for any of their keys, each `distinct` value once, the first by order.

    Of other's rows only the first of each key and value can be the first of several keys, so the join meets these alone.
    """
    best = F.min_by(F.struct(*other.columns), F.struct(*order))
    other = other.groupBy(F.col(key).alias("_k"), F.col(distinct).alias("_d")).agg(best.alias("_o")).select("_o.*")
    met = rows.withColumn(key, F.explode(keys)).join(other, key)
    first = F.min_by(F.struct(*[c for c in met.columns if c not in rows.columns]), F.struct(*order))
    return met.groupBy(*rows.columns, F.col(distinct).alias("_d")).agg(first.alias("_o")).select(*rows.columns, "_o.*")


def _tiers(hits: list[DataFrame], by_index: bool) -> DataFrame:
    every = hits[0]
    for h in hits[1:]:
        every = every.union(h)
    order = F.struct("ord", "tier") if by_index else F.struct("tier", "ord")
    return every.groupBy("query").agg(F.min(order).alias("x")).select("query", "x.ord", "x.tier")


def strict_cascade(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, ord, tier) of the best index row (ord, name, terms: lower-case search terms) of each query, by tier, then order.

    1 the whole name in any case; 2 any search term; 3 a last word of four letters or more that is a term of one row
    alone; 4 first and last words: last ones equal and one first word the beginning of the other, or both those of a
    term; 5 a last word of five letters or more that ends one name alone. Every tier is an equi-join; tier 4 joins on the
    last word. Null and blank queries find nothing.
    """
    word = lambda c, i: F.try_element_at(F.filter(F.split(c, "\\s+"), lambda x: x != ""), F.lit(i))
    q = queries.select("query").distinct().withColumn("k", F.lower(F.trim("query"))).where("k <> ''")
    q = q.withColumns({"first": word(F.col("k"), 1), "last": word(F.col("k"), -1), "two": F.instr("k", " ") > 0})
    i = index.select("ord", F.lower("name").alias("n"), "terms").where("trim(n) <> ''").withColumns({"nf": word(F.col("n"), 1), "nl": word(F.col("n"), -1), "ntwo": F.instr("n", " ") > 0})
    terms = i.select("ord", F.explode(F.array_distinct("terms")).alias("term"))
    pairs = terms.where("term like '% %'").select("ord", word(F.col("term"), 1).alias("tf"), word(F.col("term"), -1).alias("tl")).distinct()
    one_term = terms.groupBy("term").agg(F.count("*").alias("c"), F.min("ord").alias("ord")).where("c = 1")
    one_last = i.groupBy("nl").agg(F.count("*").alias("c"), F.min("ord").alias("ord")).where("c = 1")
    begins = F.col("first").startswith(F.col("nf")) | F.col("nf").startswith(F.col("first"))
    as_tier = lambda rows, k: rows.select("query", "ord", F.lit(k).alias("tier"))
    two = q.where("two")
    return _tiers([
        as_tier(q.join(i, F.col("k") == F.col("n")), 1),
        as_tier(q.join(terms, F.col("k") == F.col("term")), 2),
        as_tier(q.where("length(last) >= 4").join(one_term, F.col("last") == F.col("term")), 3),
        as_tier(two.join(i.where("ntwo"), F.col("last") == F.col("nl")).where(begins), 4),
        as_tier(two.join(pairs, (F.col("last") == F.col("tl")) & (F.col("first") == F.col("tf"))), 4),
        as_tier(q.where("length(last) >= 5").join(one_last, F.col("last") == F.col("nl")), 5),
    ], False)


#: The most rows of an index that are compared with every query, for tiers that look inside names.
SMALL_INDEX = 20_000


def contained_cascade(queries: DataFrame, index: DataFrame, tests: list, by_index: bool = False) -> DataFrame:
    """(query, ord, tier): the best index row by the first of several tests that holds; tests get (query, index row) columns.

    Tests that look inside names have no key to join on, so the index goes to every query's task: it must be small,
    and an index of more than SMALL_INDEX rows is an error. by_index: the row's order comes before the test's.
    """
    if index.limit(SMALL_INDEX + 1).count() > SMALL_INDEX:
        raise ValueError(f"an index of more than {SMALL_INDEX} rows: use cascade or strict_cascade, whose tiers have keys")
    q = queries.select("query").distinct().where("query <> ''")
    i = index.select(*[F.col(c).alias(c if c == "ord" else "_" + c) for c in index.columns])
    tier = F.coalesce(*[F.when(test, F.lit(k + 1)) for k, test in enumerate(tests)])
    found = q.join(F.broadcast(i), F.coalesce(tier, F.lit(0)) > 0).withColumn("tier", tier)
    return _tiers([found.select("query", "ord", "tier")], by_index)


def exact_then_inside(names: list[str], variants: str) -> list:
    """Tests of contained_cascade: the first name in any case or any other exactly; a variant; then the same inside the names."""
    lower = F.lower("query")
    equal = F.lower("_" + names[0]) == lower
    for n in names[1:]:
        equal = equal | (F.col("_" + n) == F.col("query"))
    inside = [F.contains(F.lower("_" + names[0]), lower), *[F.contains("_" + n, F.col("query")) for n in names[1:]]]
    return [equal, F.array_contains("_" + variants, F.col("query")), *inside, F.exists("_" + variants, lambda v: F.contains(v, F.col("query")))]


def mutual(least: int = 2) -> list:
    """Tests: equal, equal last words longer than `least`, one inside the other; in any case."""
    a, b = F.lower("query"), F.lower("_name")
    last = lambda c: F.try_element_at(F.split(c, " "), F.lit(-1))
    return [a == b, (last(a) == last(b)) & (F.length(last(a)) > least), F.contains(a, b) | F.contains(b, a)]


def best_file(files: DataFrame, key: str, order: str, tests: list[Column]) -> DataFrame:
    """(key, ord, tier): of each key's files the first by the earliest test that holds, or simply the first."""
    tier = F.coalesce(*[F.when(x, F.lit(k + 1)) for k, x in enumerate(tests)], F.lit(len(tests) + 1))
    return files.withColumn("_t", tier).groupBy(key).agg(F.min(F.struct(F.col("_t").alias("tier"), F.col(order).alias("ord"))).alias("x")).select(key, "x.ord", "x.tier")


def more_variants(rows: DataFrame, more: DataFrame, key: str, variants: str) -> DataFrame:
    """rows with the variants of more added, sorted, each once; rows without more keep theirs."""
    m = more.groupBy(key).agg(F.flatten(F.collect_list(variants)).alias("_m"))
    joined = rows.join(m, key, "left")
    none = F.array().cast(rows.schema[variants].dataType)
    return joined.withColumn(variants, F.array_sort(F.array_distinct(F.concat(F.coalesce(variants, none), F.coalesce("_m", none))))).drop("_m")
