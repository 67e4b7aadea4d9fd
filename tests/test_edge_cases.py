"""Nulls, ties, empty tables and repeated rows through the operators."""

from pyspark.sql import functions as F

from loomquill.functions import text as X
from loomquill.operators import extract, graph, link, resolve, rollup, segment, spans
from loomquill.plans import span_queries

CLEANERS = [X.ocr_repair, X.without_points, X.without_titles, X.name_key, X.title_if_lower, X.witness_name, X.answered_name, X.spaced_marks, X.unfenced, X.plain_inline, X.escaped, X.file_name, X.stripped, X.surface, X.match_key, X.plain_quotes, lambda c: X.without_artifacts(c, ("a.*b",)), lambda c: X.transcript_lines(c, "The")]


def test_cleaners_take_nulls_empty_and_long_texts(spark):
    long = "word, " * 50_000
    rows = spark.createDataFrame([(0, None), (1, ""), (2, long)], "i int, x string")
    got = rows.select("i", *[f(F.col("x")).alias(f"y{k}") for k, f in enumerate(CLEANERS)]).orderBy("i").collect()
    assert all(v is None for v in got[0][1:])
    assert all(v in ("", None) for v in got[1][1:])


def lines(spark, texts):
    return segment.lines(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"))


def test_spans_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "[The witness is sworn.]"), (4, "no marker")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in spans.between_markers(docs).collect()] == [(3, "")]
    assert spans.testimonies(docs).count() == 0
    none = lines(spark, []).where("false")
    cast = spark.createDataFrame([], "witness string, variants array<string>, others array<string>")
    begun = spans.starts(none, cast)
    assert spans.ends(none, begun, cast).count() == 0 and spans.pure_spans(none, spans.ends(none, begun, cast), cast).count() == 0
    assert spans.line_range(lines(spark, ["a\nb"]), spark.createDataFrame([(0, None), (0, "2-1"), (0, "1-9")], "doc_id long, r string"), "r").collect()[0].text == "a\nb"


def test_session_boundaries_reach_across_markers(spark):
    text = "x" * 600 + "I call Mr. Bob Carr. [The witness is sworn.] I do. [Witness is sworn] end"
    got = spans.between_markers(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("span").collect()
    assert [r.start for r in got] == [text.index("[The"), text.index("[Witness is")]
    assert got[1].lead == text[got[1].start - 500 : got[1].start] and len(got[0].lead) == 500


def test_extraction_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Ann Lee and Ann Lee")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in extract.model_entities(docs).distinct().collect()] == [(3, "Ann Lee", "PERSON")]
    assert extract.captured(docs, "(Ann)").count() == 1
    terms = spark.createDataFrame([("A", "nn Le"), ("A", ""), ("B", "e and A"), ("C", "Lee and Ann"), ("D", "e")], "entity string, term string")
    got = {r.entity: r.n_lines for r in extract.substring_hits(segment.lines(docs), terms).collect()}
    assert got == {"A": 1, "B": 1, "C": 1, "D": 1}
    assert extract.substring_hits(segment.lines(docs), terms.where("false")).count() == 0


def test_resolution_with_ties_and_nulls(spark):
    index = spark.createDataFrame([(2, "Ann Lee", ["lee", "lee"]), (1, "Ann Lee", ["ann"]), (3, None, None), (4, "", [""])], "ord int, name string, terms array<string>")
    q = spark.createDataFrame([("ann lee",), ("ann lee",), (None,), ("",), ("x lee",)], "query string")
    got = {r.query: (r.ord, r.tier) for r in resolve.strict_cascade(q, index).collect()}
    assert got == {"ann lee": (1, 1)}
    got = {r.query: (r.ord, r.tier) for r in resolve.contained_cascade(q, index.where("name is not null"), resolve.mutual()).collect()}
    assert got["ann lee"] == (1, 1)
    assert resolve.strict_cascade(q.where("false"), index).count() == 0


def test_rollups_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "y", 3)], "k string, t string, i int")
    assert {r.k: r.contexts for r in rollup.contexts(rows.dropna(), "k", ["i"], "t").collect()} == {"a": ["x"]}
    got = rollup.outcomes(rows, "k", "t", ["x"]).where("k = 'a'").first()
    assert (got.total, got.x, got.other) == (2, 1, 1)
    assert rollup.appearances(rows.where("false"), "k", ["i"]).count() == 0


def test_edge_ids_go_on(spark):
    new = spark.range(50).repartition(4)
    ids = [int(r.id.removeprefix("edge_")) for r in graph.numbered(new.select(F.col("id").alias("n")), spark.createDataFrame([("edge_9",)], "id string"), ["n"]).orderBy("n").collect()]
    assert ids == list(range(10, 60))
    assert graph.numbered(new.where("false").select(F.col("id").alias("n")), spark.createDataFrame([("x",)], "id string"), ["n"]).count() == 0


def test_linking_by_words_is_linking(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met Bob, bob and ANN."), (2, None), (3, "nobody")], "doc_id long, text string")
    terms = [("Ann", "P", "p1"), ("Ann Lee", "P", "p2"), ("Bob", "P", "p3")]
    a = sorted(map(tuple, link.link(docs, terms).collect()))
    b = sorted(map(tuple, link.link_by_words(docs, spark.createDataFrame(terms, "term string, type string, id string")).collect()))
    assert a == b and a[0][2] == 4


def test_edge_ids_of_many_rows_and_nulls(spark):
    old = spark.createDataFrame([("edge_9",)], "id string")
    new = spark.range(0, 300_000, 1, 8).select((F.col("id") * 7919 % 300_000).alias("n"))
    got = graph.numbered(new, old, ["n"])
    assert got.where(F.coalesce(F.col("id") != F.concat(F.lit("edge_"), (F.col("n") + 10).cast("string")), F.lit(True))).count() == 0
    assert got.count() == 300_000
    rows = spark.createDataFrame([(None, 1), (2, None), (2, 1), (1, 5)], "n int, m int")
    got = {(r.n, r.m): r.id for r in graph.numbered(rows, old, ["n", "m"]).collect()}
    assert got == {(1, 5): "edge_10", (2, 1): "edge_11", (2, None): "edge_12", (None, 1): "edge_13"}


def test_lines_lose_blanks_of_any_width(spark):
    rows = spark.createDataFrame([(" a  b　\n \n c​",)], "x string")
    assert rows.select(X.collapse_lines(F.col("x"))).first()[0] == "a  b\n\nc​"


def test_neighbours_of_one_blank_count_as_in_sql(spark, tmp_path):
    spark.createDataFrame([(1, "idiot moron, idiot"), (2, "an idiot"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(span_queries.q_link_by_words(spark, str(tmp_path)).first()) == (2, 3)


def test_hits_of_repeated_documents_and_no_shuffle_of_words(spark):
    rows = segment.lines(spark.createDataFrame([(1, "a the b\nx the y"), (1, "z the z"), (2, "the"), (None, "of the c")], "doc_id long, text string"))
    found = extract.substring_hits(rows, spark.createDataFrame([("A", " the "), ("A", "the"), ("B", "x the y")], "entity string, term string"))
    assert sorted(map(tuple, found.collect())) == [("A", 4, 2), ("B", 1, 1)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_first_of_several_keys_and_its_join(spark):
    rows = spark.createDataFrame([("n", [1, 2]), ("m", [2]), ("o", None)], "node string, keys array<int>")
    other = spark.createDataFrame([(1, 5, "x"), (2, 3, "x"), (2, 9, "y"), (1, 4, None), (3, 0, "z")] + [(2, 100 + i, "y") for i in range(50)], "k int, v int, d string")
    out = resolve.first_of(rows, F.col("keys"), other, "k", ["v"], "d")
    assert sorted(map(tuple, out.select("node", F.coalesce("d", F.lit("-")), "v").collect())) == [("m", "x", 3), ("m", "y", 9), ("n", "-", 4), ("n", "x", 3), ("n", "y", 9)]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]


def test_padded_links_over_sessions_and_their_cut(spark):
    keys = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 9)], "key int, session int")
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (12, 1), (13, 1), (13, 1)], "node int, session int")
    entities = spark.createDataFrame([(10, "P", 3), (11, "P", 1), (12, "P", 2), (13, "Q", 1), (13, "Q", 1), (14, "P", 0)], "node int, type string, ord int")
    out = graph.padded_links(keys, members, entities, {"P": 2, "Q": 2})
    got = sorted(tuple(r)[:4] for r in out.collect())
    m, r = "MENTIONED_IN", "RELATED_TO"
    assert got == [(1, 11, "P", m), (1, 12, "P", m), (1, 13, "Q", m), (1, 13, "Q", m), (2, 10, "P", m), (2, 11, "P", m), (2, 13, "Q", r), (2, 13, "Q", r), (3, 11, "P", r), (3, 13, "Q", r), (3, 13, "Q", r), (3, 14, "P", r)]
    keyed = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [session" in keyed


def test_pairs_of_large_groups_are_counted(spark):
    import random
    from collections import Counter

    r = random.Random(3)
    groups = {g: r.sample(range(400), r.choice([2, 3, 90, 150])) for g in range(40)}
    want = Counter((f"n{min(a, b, key=lambda v: f'n{v}')}", f"n{max(a, b, key=lambda v: f'n{v}')}") for v in groups.values() for i, a in enumerate(v) for b in v[:i])
    rows = [(g, f"n{x}") for g, v in groups.items() for x in [*v, v[0]]] + [(None, "n1"), (None, "n2"), (1, None)]
    members = spark.createDataFrame(rows, "g int, x string")
    found = graph.cooccurrence(members, "g", "x")
    assert {(p.a, p.b): p.weight for p in found.collect()} == want
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    few, graph.FEW_GROUPS = graph.FEW_GROUPS, 1
    try:
        assert {(p.a, p.b): p.weight for p in graph.cooccurrence(members, "g", "x").collect()} == want
    finally:
        graph.FEW_GROUPS = few
