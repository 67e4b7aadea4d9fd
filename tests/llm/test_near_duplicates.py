"""The near-duplicate and repeated-passage stages against brute force."""

import random

import pytest

import corpus_pipeline
from loomquill.llm import minhash, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, data):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], SCHEMA)


def words(r, n):
    return [f"w{r.randint(0, 50_000)}" for _ in range(n)]


def near_texts(seed=1):
    """Texts with copies by kind of edit, on both sides of 0.8."""
    r, out = random.Random(seed), []
    for n in (60, 200):
        for share in (0.05, 0.1, 0.15, 0.18, 0.24, 0.3, 0.4):
            for _ in range(4):
                base, k = words(r, n), int(n * share)
                cut = r.randint(0, n - k)
                spread = list(base)
                for i in r.sample(range(n), max(1, k // 6)):
                    spread[i] = "changed"
                out += [base, base + words(r, k), base[: n - k], base[:cut] + words(r, k) + base[cut + k :], spread]
    chain = words(r, 200)
    for k in range(12):  # each is near the one before, the ends aren't near each other
        out.append(chain[6 * k :] + [f"c{i}" for i in range(6 * k)])
    return [" ".join(x) for x in out] + ["", " ", "One two", "one  TWO", "one two three"]


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(data):
    """The least place reachable by pairs of five-word Jaccard 0.8 or more."""
    s = [sets(t) for t in data]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if n * 5 >= (len(s[i]) + len(s[j]) - n) * 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(s))]


@pytest.mark.parametrize("here", [minhash.HERE, 60])
def test_copies_of_every_kind_are_found_and_nothing_else_goes(spark, monkeypatch, here):
    """With shingle sets compared in their cells, and larger ones in a join."""
    monkeypatch.setattr(minhash, "HERE", here)
    data = near_texts()
    want = {i for i, g in enumerate(groups(data)) if g == i}
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, list(enumerate(data))), "").collect()}
    assert got - want == set(), "copies of 0.8 or more stay"
    assert want - got == set(), "texts below 0.8 go"


def test_simhash_finds_its_pairs_by_itself_and_they_are_checked(spark, monkeypatch):
    """Without any band in common: pairs within reach stay groups, and one fingerprint for different texts is no link."""

    def unlike(h):
        import numpy as np

        return np.frombuffer(np.random.default_rng(h).bytes(8 * 30), np.int64), bytes(150)

    monkeypatch.setattr(minhash, "signature", unlike)
    r = random.Random(3)
    data = []
    for _ in range(20):
        base = words(r, 300)
        data += [base, [*base[:-1], "changed"], ["changed", *base[1:]]]
    data += [["a"] * 500 + words(r, 100) for _ in range(3)]
    data = [" ".join(x) for x in data]
    bits = [simhash.simhash(x) for x in data]
    near = [all((bits[i] ^ bits[j]).bit_count() <= 4 for j in range(i - i % 3, i)) for i in range(len(data))]
    assert len(set(bits[-3:])) == 1 and sum(near[:-3]) > 50
    got = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, frame(spark, list(enumerate(data))), "").collect()}
    assert not [i for i in range(60) if i % 3 and near[i] and i in got], "pairs within reach were lost"
    assert got >= {*range(0, 60, 3), 60, 61, 62}, "texts below 0.8 go"


def test_pairs_of_a_cell_that_miss_its_first_text_are_compared():
    import numpy as np

    sig = np.zeros((5, minhash.BANDS * minhash.ROWS), np.uint8)
    got = {frozenset((i, j)) for i, js in minhash.across(np.array([7, 7, 8, 9, 7]), sig) for j in js.tolist()}
    assert got == {frozenset(p) for p in ((0, 2), (1, 2), (4, 2), (0, 3), (1, 3), (4, 3), (2, 3))}


def test_rows_without_an_id_and_texts_that_share_an_id(spark):
    r = random.Random(2)
    a, b, c, d = (" ".join(words(r, 80)) for _ in range(4))
    data = [(None, a), (None, b), (None, a), (None, None), (1, a), (1, b), (2, c), (2, c), (3, c + " more"), (4, d)]
    got = sorted(((x.doc_id or 0, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, frame(spark, data), "").collect()), key=str)
    assert got == sorted([(0, a), (0, b), (0, a), (0, None), (1, a), (1, b), (2, c), (4, d)], key=str)
