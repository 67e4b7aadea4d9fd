"""Exact top-k: ties, repeated ids, huge components, blocks, and how much the threshold saves."""

import numpy as np

from loomquill.llm import topk


def brute(data, k, every, scale=256):
    rows = [(i, [int(np.floor(np.float64(x) * scale)) if abs(x) < 1e15 else int(x) * scale for x in e]) for i, e in data]
    out = []
    for qi, q in rows:
        if qi % every == 0:
            found = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in rows if i != qi)[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def got(spark, data, **kw):
    df = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), **kw)
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_ties_repeated_rows_and_blocks(spark):
    r = np.random.default_rng(1)
    data = [(i, [float(x) for x in r.integers(-1, 2, 6)]) for i in range(120)] + [(10, [1.0] * 6), (10, [1.0] * 6), (11, [1.0] * 6)]
    for block in (32_768, 3):
        assert got(spark, data, k=5, every=10, block=block) == brute(data, 5, 10)


def test_huge_components(spark):
    data = [(0, [1e20, 1.0]), (1, [1e20, -3.0]), (2, [-1e20, 0.5]), (3, [1e306, 1.0]), (4, [0.0, 2.0])]
    assert got(spark, data, k=4, every=3) == brute(data, 4, 3)


def test_the_threshold_saves_most_full_products():
    r = np.random.default_rng(2)
    v = r.normal(size=(4000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))
    q, own = v[::50], np.arange(0, 4000, 50)[:, None] == np.arange(4000)[None, :]
    j, i, s = topk.listed(q, v, own, 5)
    best = topk.Best(5)
    best.add(j, i, s)
    j, _, s = best.kept()
    cutoff = s.reshape(len(q), 5)[:, -1].astype(float)
    work = [0, 0]
    j, i, s = topk.collected(q, v, own, cutoff, work)
    full = q @ v.T
    full[own] = -np.inf
    assert sorted(zip(j.tolist(), i.tolist(), strict=True)) == [(int(a), int(b)) for a, b in zip(*np.nonzero(full >= cutoff[:, None]), strict=True)]
    assert (s == full[j, i]).all()
    pairs = full.size
    assert work[1] < 0.05 * pairs and work[0] < 0.9 * topk.FRAGMENTS * pairs
