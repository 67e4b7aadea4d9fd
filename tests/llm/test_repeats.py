"""Repeated windows of words and bytes against brute force: every path, weak hashes, odd words."""

import hashlib
import random

import pytest
from test_llm_operators import frame, rows

from loomquill.llm import recompression, repeats, suffixes


def brute_words(data, window=20):
    seen, want = set(), {}
    for d, t in data:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        want[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return want


def brute_bytes(data, window=200):
    times, want = {}, {}
    for _, t in data:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            times[b[i : i + window]] = times.get(b[i : i + window], 0) + 1
    for d, t in data:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if times[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return want


def words_of(spark, data, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.repeated_words(frame(spark, data), **kw).collect()}


def bytes_of(spark, data, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_bytes(frame(spark, data), **kw).collect()}


@pytest.mark.parametrize("held", [10_000, 1])
def test_against_brute_force(spark, held):
    data = rows()
    assert words_of(spark, data, held=held) == brute_words(data)
    assert bytes_of(spark, data, held=held) == brute_bytes(data)


def test_frequent_passages_with_different_neighbours(spark):
    r = random.Random(3)
    line = " ".join(f"l{i}" for i in range(14))
    word = lambda: r.choice("abcdefghij") * r.randint(1, 3)
    data = [(d, " ".join([*(word() for _ in range(r.randint(0, 30))), line, *(word() for _ in range(r.randint(0, 30)))])) for d in range(80)]
    data += [(100 + d, f"pre{d % 3} {line} a b c d e f g h tail{d}") for d in range(30)]
    for held in (10_000, 20, 1):
        assert words_of(spark, data, held=held) == brute_words(data)
        assert bytes_of(spark, data, held=held) == brute_bytes(data)


def test_a_line_that_documents_have_many_times_goes_to_the_corpus_once(spark, monkeypatch):
    """Repeats inside a document are compared there: what is compared between documents doesn't grow with them."""
    line = " ".join(f"line{i}" for i in range(30))
    sizes: dict[str, list[int]] = {}
    real = repeats.written

    def counted(df, name, passing=None):
        out = real(df, name, passing)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(repeats, "written", counted)
    data = [(d, " ".join(f"{line} {hashlib.md5(f'{d} {i}'.encode()).hexdigest()}" for i in range(40))) for d in range(12)]
    data += [(50, f"{line} {line} {line}"), (51, line), (52, f"alone {' '.join(f'p{i}' for i in range(60))} " * 3)]
    assert words_of(spark, data) == brute_words(data)
    assert bytes_of(spark, data) == brute_bytes(data)
    assert max(sizes["ends"]) < 12 * 40 / 2


def test_a_document_compares_its_own_contexts():
    """Equal hashes of different bytes stay rows of their own."""
    import numpy as np

    same = np.zeros(4, np.int64)
    got, more = repeats.once(same, same, same, same, same, np.array([5, 1, 9, 12]), [b"x", b"x", b"x", b"y"])
    assert got.tolist() == [1, 3] and [(i, p.tolist()) for i, p in more] == [(0, [5, 9])]


def test_what_equal_hashes_tell_is_compared(spark, monkeypatch):
    """Hashes of a few bits, at the first try, take different contexts for equal; runs differ then, and all is done under other hashes."""
    tries = []
    attempt = repeats._attempt
    monkeypatch.setattr(repeats, "_attempt", lambda rows, kind, held, seed: tries.append(seed) or attempt(rows, kind, held, seed))
    r = random.Random(9)
    data = [(d, " ".join(r.choice("abcdefgh") for _ in range(140))) for d in range(30)]
    data += [(100 + d, data[d][1]) for d in range(3)]
    assert words_of(spark, data, bits=2) == brute_words(data)
    assert bytes_of(spark, data, bits=1) == brute_bytes(data)
    assert tries == [0, 1, 0, 1]


def test_words_of_a_thousand_letters(spark):
    """The words that a sum of powers modulo 2^64 can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    common = [f"w{i}" for i in range(19)]
    data = [(1, " ".join([a, *common])), (2, " ".join([b, *common])), (3, " ".join([a, *common, b, *common])), (4, " ".join([a] * 30 + [b] * 30))]
    assert words_of(spark, data) == brute_words(data)
    assert bytes_of(spark, data) == brute_bytes(data)


def test_frequent_keys_are_dealt_out(spark, monkeypatch):
    from loomquill.llm import common

    monkeypatch.setattr(common, "CROWD", 5)
    left = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(80)] + [(None, 99)], "k int, v int")
    right = left.groupBy("k").count()
    got = common.spread_join(left, right, ["k"], "count", ["v"])
    assert got.columns == ["k", "v", "count"]
    assert sorted(map(tuple, got.collect())) == sorted((i % 3 if i < 60 else i, i, 20 if i < 60 else 1) for i in range(80))


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"v{i}" for i in range(100))
    data = [(1, long), (1, long), (1, long + " x"), (None, long), (None, None), (None, "")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in recompression.repeated_words(frame(spark, data)).collect())
    assert got == sorted([(0, 100, 0), (0, 0, 0), (0, 0, 0), (1, 100, 100), (1, 100, 100), (1, 101, 100)])
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixes.repeated_bytes(frame(spark, data)).collect())
    n = len(long)
    assert got == sorted([(0, n), (0, 0), (0, 0), (1, n), (1, n), (1, n)])


def test_symbols_of_equal_words_are_equal_inside_their_margins():
    r = random.Random(11)
    for rounds in (1, 2, 3):
        before, behind = recompression.margins(rounds)
        for splits in ((0,) * rounds, (1,) * rounds):
            for _ in range(300):
                inner = [r.choice("abcde").encode() for _ in range(40)]
                got = []
                for _ in range(2):
                    left = [r.choice("abcde").encode() for _ in range(r.randint(0, 20))]
                    words = [*left, *inner, *(r.choice("abcde").encode() for _ in range(r.randint(0, 20)))]
                    symbols = recompression.named(words, *recompression.run_places(words))
                    for k, split in enumerate(splits):
                        symbols = recompression.merged(*symbols, k, split)
                    place = symbols[0] - len(left)
                    on = (place >= before) & (place <= 40 - behind)
                    got.append(list(zip(place[on].tolist(), symbols[1][on].tolist(), strict=True)))
                assert got[0] == got[1]


def test_rounds_take_the_split_that_merges_most(spark):
    data = rows()
    splits = recompression.agreed(repeats.keyed(frame(spark, data), "doc_id", "text", True))
    sums = {}
    for _, t in data:
        words = (t or "").encode().split()
        if len(words) > 1:
            symbols = recompression.named(words, *recompression.run_places(words))
            for r in range(2):
                for s in range(recompression.SPLITS):
                    sums[r, s] = sums.get((r, s), 0) + int(recompression.pairs(symbols[1], symbols[2], r, s).sum())
                symbols = recompression.merged(*symbols, r, splits[r])
    assert splits == tuple(max(range(recompression.SPLITS), key=lambda s: sums[r, s]) for r in range(2))
