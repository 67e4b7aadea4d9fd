"""The toxicity model against the whole labelled sample."""

import math
import random

import numpy as np

from loomquill.llm import toxicity


def brute(counts, share):
    """Log-odds of each word from all counts, by dictionaries."""
    out = []
    for n in (4, 5, None):
        sums = {}
        for w, c, t in counts:
            x = sums.setdefault(w if n is None else w[:n], [0, 0])
            x[0] += c
            x[1] += t
        table = {}
        for w, (c, t) in sums.items():
            up = next((above[w[:m]] for m, above in ((5, out[1:2]), (4, out[:1])) if above and len(w) > m for above in above), 0.0)
            mean = 1 / (1 + math.exp(share - up))
            p = (t + toxicity.STRENGTH * mean) / (c + t + toxicity.STRENGTH)
            table[w] = math.log(p / (1 - p)) + share
        out.append(table)
    return out[-1]


def test_every_word_of_the_sample_keeps_its_own_score(spark):
    r = random.Random(7)
    counts = [(f"common{i}", 3, 0) for i in range(70_000)] + [(f"zz{i}é", r.randint(0, 2), r.randint(1, 2)) for i in range(500)] + [("abc", 1, 1), ("abcd", 0, 2), ("abcde", 2, 0)]
    tables = toxicity.odds(spark.createDataFrame(counts, "w string, c long, t long"), math.log(3))
    model, want = toxicity.Model(tables, 1.0, 0.0), brute(counts, math.log(3))
    words = list(want)
    assert len(tables[-1].keys) == len(want)
    np.testing.assert_allclose(model.tokens(words), [want[w] - toxicity.DRIFT for w in words], atol=1e-9)
    stem = model.tokens(["abcdefgh", "abcdq", "none at all", "ab"])
    assert stem[2] == stem[3] == -toxicity.DRIFT and stem[0] != stem[1]


def maximal(scores, at=0):
    """By definition: the segment of greatest sum, then the same on both sides of it; quadratic."""
    best = max(((sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    total, i, j = best[0], -best[1], -best[2]
    return [*maximal(scores[:i], at), (at + i, at + j, total), *maximal(scores[j:], at + j)]


def test_segments_are_all_maximal_ones():
    r = random.Random(8)
    for _ in range(300):
        scores = [r.gauss(-0.3, 1) for _ in range(r.randint(0, 30))]
        got, want = toxicity.segments(np.array(scores)), maximal(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want])


def test_words_against_end_a_passage():
    memo = {"vile": 4.0, "kind": -9.0, "of": -1.0}
    n, found = toxicity.scan("vile of vile kind vile", None, memo)
    assert n == 5 and [f[:2] for f in found] == [(0, 3), (4, 5)]


def test_odd_labels_and_rows(spark):
    schema = "doc_id long, text string, labels int, score double"
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefg") * 3 for _ in range(30)) + (" vile vileness vilest" if i % 5 == 0 else ""), 1, 0.0) for i in range(200)]
    docs += [(None, "vile vile vileness", 1, 0.0), (None, None, 1, 0.0), (0, docs[0][1], 1, 0.0), (7, "", 1, 0.0)]
    f = spark.createDataFrame(docs, schema)
    labels = [(i, None if i % 7 == 0 else int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, 0), (3, 0)]
    got = toxicity.toxicity(f, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 for x in rows)
    assert len({x.score for x in rows if x.doc_id == 0}) == 1
    assert sum(x.doc_id is None for x in rows) == 2
    for few in ([], [(1, 0), (2, 0)], [(5, 1)]):
        got = toxicity.toxicity(f, spark.createDataFrame(few, "doc_id long, toxic int"))
        assert got.count() == len(docs) and got.where("score is null").isEmpty()
