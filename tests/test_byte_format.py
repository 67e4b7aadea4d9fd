"""Sizes of every unit, from a table with long texts."""

from loomquill.plans import catalogue


def test_documents_of_a_mebibyte_and_more_have_a_size(spark, tmp_path):
    sizes = {1: (1023, "1023 B"), 2: (1536, "1.5 KB"), 3: (1048576, "1 MB"), 4: (5 * 1048576 // 2, "2.5 MB"), 5: (3 * 1024**3, "3 GB")}
    spark.createDataFrame([(i, n) for i, (n, _) in sizes.items()], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.size for r in catalogue.QUERIES["q_byte_format"](spark, str(tmp_path)).collect()}
    assert got == {i: want for i, (_, want) in sizes.items()}
