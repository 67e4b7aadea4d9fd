"""The pipeline's stages: columns, and what each keeps, against plain rules on small tables."""

import random

import corpus_pipeline
from loomquill.llm.words import word_encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, spans int"


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, d)
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert corpus_pipeline.run(spark, d).count() >= docs.count()


def frame(spark, data):
    """Columns that clash with names the operators use."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 7, 1) for d, t in data], SCHEMA)


def labelled(spark, path, seed=5):
    """Documents of clean words, toxic ones and junk, with labels for most; null, empty and repeated rows."""
    r = random.Random(seed)
    word = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    data, marks = [], {}
    for d in range(300):
        w = [r.choice(word) for _ in range(80)]
        kind = ("clean", "toxic", "junk", "clean")[d % 4]
        if kind == "toxic":
            w[30:33] = ["vile", "scummy", "vileness"]
        data.append((d, " ".join(x + "&&&" for x in w) if kind == "junk" else " ".join(w)))
        marks[d] = kind
    spark.createDataFrame([(d, int(k != "junk"), int(k == "toxic")) for d, k in marks.items() if d % 10], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return [*data, (None, None), (None, ""), (1000, None), (0, data[0][1])], marks


def test_filters_reject_what_they_are_for(spark, tmp_path):
    data, marks = labelled(spark, tmp_path)
    docs = frame(spark, data)
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    got = [r.doc_id for r in kept.collect()]
    assert {marks[d] for d in got if d in marks} == {"clean", "toxic"} and got.count(0) == 2 and got.count(None) == 2
    kept = corpus_pipeline.drop_toxic(spark, kept, str(tmp_path))
    got = [r.doc_id for r in kept.collect()]
    assert {marks[d] for d in got if d in marks} == {"clean"} and sum(marks.get(d) == "clean" for d in set(got)) == 150
    assert kept.columns == docs.columns and got.count(None) == 2


def test_repeated_passages_stay_once(spark):
    r = random.Random(6)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage, short = words(60), words(49)
    own = [words(30) for _ in range(6)]
    data = [(2, " \n".join([*own[0], *passage, *own[1]])), (1, " ".join([*own[2], *passage])), (3, " ".join([*short, *own[3]])), (4, " ".join([*own[4], *short])), (None, "\t".join(own[5])), (5, None), (6, "")]
    out = {r_.doc_id: r_ for r_ in corpus_pipeline.drop_repeated_passages(spark, frame(spark, data), "").collect()}
    assert out[2].text == " \n".join(own[0]) + " \n" + " \n".join(own[1])
    assert out[2].n_chars == len(out[2].text)
    for d, t in data[1:]:
        assert out[d].text == t


def test_packing_holds_every_piece_once(spark):
    r = random.Random(7)
    data = [(d, " ".join(str(r.randint(0, 999)) for _ in range(r.randint(0, 300)))) for d in range(60)] + [(None, None), (7, "again")]
    rows = corpus_pipeline.pack(spark, frame(spark, data), "").collect()
    w = word_encoder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(x.length for x in rows) == sum(len(w.encode(t or "")) // 4 + 1 for _, t in data)
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
