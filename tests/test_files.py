"""Sources and sinks on files, and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from loomquill.sinks import export
from loomquill.sources import files
from loomquill.streaming import ingest


@pytest.fixture
def archive(tmp_path):
    for folder, name, text in (("vol1", "001.md", "**Session:** 1\n**Volume:** 1\n(2 May 1961)\nA"), ("vol1", "006-008.md", "**Sessions:** 6, 7, 8\nB"), ("vol2", "notes.md", "x"), ("vol2", "010.txt", "y\nz"), ("vol2", "011.md", "")):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(text)
    return tmp_path


def test_text_files_by_name_and_size(spark, archive):
    got = files.text_files(spark, f"{archive}/in").orderBy("folder", "name")
    assert [(r.folder, r.name, r.size) for r in got.collect()][:2] == [("vol1", "001.md", 43), ("vol1", "006-008.md", 23)]
    assert files.text_files(spark, f"{archive}/in", least=30).count() == 1
    heads = {r.name: (r.sessions, r.volume, r.date) for r in files.with_header(got).collect()}
    assert heads["001.md"] == ([1], 1, "2 May 1961") and heads["006-008.md"] == ([6, 7, 8], None, None)
    assert [r.name for r in files.with_header(got, strict=True).collect()] == ["001.md"]


def test_listing_and_one_file(spark, archive):
    rows = files.listing(spark, f"{archive}/in", [("00", "Session"), ("note", "Notes")], glob="*.md").collect()
    assert {(r.name, r.description) for r in rows} == {("001.md", "Session"), ("006-008.md", "Session"), ("notes.md", "Notes")}
    one = files.one_file(spark, f"{archive}/in/vol2", "010.txt").first()
    assert (one.size, one.n_lines, one.text) == (3, 2, "y\nz")
    for bad in ("../001.md", "a/b", "", ".hidden"):
        with pytest.raises(ValueError):
            files.one_file(spark, f"{archive}/in", bad)
    assert files.first_existing(spark, [f"{archive}/none", f"{archive}/in", f"{archive}"]) == f"{archive}/in"
    assert files.first_existing(spark, [f"{archive}/none"]) is None


@pytest.mark.parametrize("field", ["nodes", "entities"])
def test_graphs_come_and_go(spark, tmp_path, field):
    node = {"id": "n1", "type": "PERSON", "name": "Ann", "sessions": [1, 2], "mentions": 3, "extra": 1}
    (tmp_path / "g.json").write_text(json.dumps({field: [node, {"id": "n2"}], "edges": [{"id": "e1", "source": "n1", "target": "n2", "type": "X"}]}, indent=1))
    nodes, edges = files.graph(spark, f"{tmp_path}/g.json")
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [("n1", "PERSON", "Ann", [1, 2], 3), ("n2", None, None, None, None)]
    export.graph_json(nodes, edges, f"{tmp_path}/out", source="test")
    assert spark.read.json(f"{tmp_path}/out/metadata").first().asDict() == {"nodes": 2, "edges": 1, "source": "test"}
    assert spark.read.json(f"{tmp_path}/out/edges").first().target == "n2"
    with pytest.raises(ValueError):
        export.graph_json(spark.read.json(f"{tmp_path}/out/nodes"), edges, f"{tmp_path}/out")


def test_testimony_files(spark, tmp_path):
    rows = spark.createDataFrame([("Ann (Lee)", 3, "Text."), ("Ann Lee", None, "More.")], "name string, session int, text string")
    export.testimony_files(rows, f"{tmp_path}/t", "name", "session", "text")
    found = sorted(p.read_text() for p in (tmp_path / "t" / "file=Ann_Lee").glob("part-*"))
    assert "".join(found).count("# Testimony of") == 2 and "**Session:** 3" in "".join(found)


def test_lists_inherit_and_stored_tables_are_read(spark, tmp_path):
    (tmp_path / "list.csv").write_text("n,tape,session,name\n1,a,1,Ann\n2,a,,Bob\n3,b,2,\n4,b, ,Cy\n")
    rows = files.session_list(spark, f"{tmp_path}/list.csv", "tape", "n", "session").orderBy("n").collect()
    assert [r.session for r in rows] == ["1", "1", "2", "2"]
    made = []
    for _ in range(2):
        out = files.or_stored(spark, f"{tmp_path}/stored", lambda: made.append(1) or spark.range(3))
        assert out.count() == 3
    assert made == [1]


def test_new_files_are_ingested_once(spark, tmp_path):
    source, table, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "table", "checkpoint"))
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(source)
        for _ in range(2):
            ingest.ingest(spark, source, "id long", table, checkpoint)
        assert spark.read.parquet(table).count() == 10 * (i + 1)


def test_windows_of_a_stream_leave_late_rows_out(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema, source = "ts timestamp, k string, id long", f"{tmp_path}/events"
    batches = [[(at(1), "a", 1), (at(1, 30), "a", 2)], [(at(9), "a", 3)], [(at(1, 10), "a", 4), (at(9, 5), "b", 3)], [(at(20), "a", 5)], [(at(23, 59), "z", 6)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        out = ingest.windowed(stream, "ts", "1 hour", "1 hour", "k")
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").option("path", f"{tmp_path}/t1").trigger(availableNow=True).start().awaitTermination()
        once = ingest.once_each(stream, "id", "ts", "12 hours")
        once.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c2").option("path", f"{tmp_path}/t2").trigger(availableNow=True).start().awaitTermination()
    counts = {(r.start.hour, r.k): r.n for r in spark.read.parquet(f"{tmp_path}/t1").collect()}
    assert counts == {(1, "a"): 2, (9, "a"): 1, (9, "b"): 1, (20, "a"): 1}
    ids = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t2").collect())
    assert ids.count(3) == 1 and ids.count(1) == 1


def test_outcomes_with_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("a", "failed"), ("b", None), ("c", "done")], "name string, status string")
    got = export.index(rows, "name", "status").first()
    assert (got.total, got.failed, got.failures) == (3, 1, ["a"])
    assert export.index(rows.where("false"), "name", "status").first().total == 0
    assert export.sent(rows.where("false"), rows).count() == 0
    assert rows.select(F.size(F.array(*files.attributes(F.col("name"))[3:])).alias("n")).count() == 3
