from pyspark.sql import functions as F

from loomquill.functions import text as X
from loomquill.operators import graph, link, resolve, segment
from loomquill.sources.html import markdown


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, X.surface, "**  Mr. Smith,: ") == "Mr. Smith"
    assert one(spark, X.match_key, " The A Court") == "court"
    assert one(spark, lambda c: X.slug("person", c), "Été d'Or!") == "person-été-dor"
    assert one(spark, lambda c: X.slug("person", c), "!!") == "person-unknown"
    assert one(spark, X.unwrap, "a\nb\n\n> q\nr\n\n\nc") == "a b\n\n> q\nr\n\nc"
    assert one(spark, X.plain_quotes, "‏צ״ה") == 'צ"ה'
    assert one(spark, X.without_markers, "x [[PERSON:p-1|Ann]] y") == "x Ann y"
    assert one(spark, X.follow_ups, "z\n---\n1. a\n2) b\n3. c\n4. d") == ["a", "b", "c"]
    assert one(spark, X.context_rule, "**Q.** when?") == "question"


def test_packed_chunks_cover_all_lines(spark):
    d = spark.createDataFrame([(1, "aaa\nbb\ncccc\nd"), (2, ""), (3, None)], "doc_id long, text string")
    rows = [tuple(r) for r in segment.packed_chunks(d, 5).orderBy("doc_id", "chunk_id").collect()]
    assert rows == [(1, 0, 0, 1, 6), (1, 1, 2, 3, 6), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_intervals_part_the_rows(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")], "k int, i int, v string")
    rows = [tuple(r) for r in segment.intervals(d, "k", ["i"], "v").orderBy("start").select("v", "start", "end", "n").collect()]
    assert rows == [("a", 0, 1, 2), ("b", 2, 3, 2), ("a", 4, 4, 1)]


def test_links_strip_to_the_text_and_come_once(spark):
    terms = [("Ann", "PERSON", "p1"), ("Ann Lee", "PERSON", "p2")]
    text = "# Ann\nann lee met Ann; [[PERSON:p1|Ann]] annex"
    mark = link.linker(terms)
    marked, n = mark(text)
    assert n == 2 and marked == "# Ann\n[[PERSON:p2|ann lee]] met [[PERSON:p1|Ann]]; [[PERSON:p1|Ann]] annex"
    assert mark(marked) == (marked, 0)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 2)], "a int, b int")
    assert {tuple(r) for r in graph.undirected(e).collect()} == {(1, 2), (3, 3), (2, 4)}
    assert {r.node: r.degree for r in graph.degrees(e).collect()}[3] == 2
    m = spark.createDataFrame([(4, 1)], "old int, new int")
    assert {tuple(r) for r in graph.redirect(e, m).collect()} == {(1, 2), (2, 1), (3, 3)}


def test_unmapped_names_go_unless_kept(spark):
    r = spark.createDataFrame([("x",), ("Canon",), ("other",)], "name string")
    m = spark.createDataFrame([("Canon", "X")], "canonical string, variant string")
    assert sorted(x.canonical for x in resolve.apply_map(r, m, "name").collect()) == ["Canon", "Canon"]
    assert sorted(x.canonical for x in resolve.apply_map(r, m, "name", True).collect()) == ["Canon", "Canon", "other"]


def test_markdown():
    assert markdown("<h1>T</h1><p>a <b>b</b><br>c<script>x</p></script></p><ul><li>i</ul>") == "# T\n\na **b**\nc\n\n- i"
