"""The training-data operators against brute force and libraries, with odd inputs."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from loomquill.llm import bpe, fingerprints, packing, quality, recompression, simhash, suffixes, tokenfile, topk, toxicity
from loomquill.llm.common import fresh_path
from loomquill.llm.words import word_encoder

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, fp int, score int"
LONG = " ".join(f"w{i % 977}" for i in range(6000))


def rows(seed=1, n=40):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abc") for _ in range(r.randint(5, 90))) for _ in range(5)]
    out = []
    for d in range(n):
        parts = [r.choice([r.choice(pool), " ".join(["x"] * r.randint(1, 50)), " ".join(["x", "y"] * r.randint(1, 60)), " ".join(str(r.randint(0, 50)) for _ in range(r.randint(1, 40)))]) for _ in range(r.randint(0, 6))]
        out.append((d, r.choice([" ", "\n", " \t"]).join(parts)))
    return [*out, (n, None), (n + 1, ""), (n + 2, LONG), (n + 3, LONG[:-3] + "z"), (n + 4, "É é 　 <|endoftext|> 'll 中文")]


def frame(spark, data):
    return spark.createDataFrame([(d, t, None, None, None, 1, 1, 1) for d, t in data], SCHEMA)


def test_packing(spark):
    data = rows()
    out = packing.pack(frame(spark, data), WORDS, 256, 0)
    got = out.toPandas()
    w = word_encoder(WORDS)
    size = {d: len(w.encode(t or "")) // 4 + 1 for d, t in data}
    assert got.groupby("doc_id").length.sum().to_dict() == size
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= sum(size.values()) / 256 * 1.02 + 1
    ids = {r.sequence_id: r.ids for r in packing.sequences(frame(spark, data), out, WORDS, 256, 0).collect()}
    assert sum(map(len, ids.values())) == sum(size.values())


def test_packing_reads_texts_in_small_batches(spark, monkeypatch):
    """Buffers of 10,000 texts on both sides of a worker took an executor beyond its memory."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), packing.written
    monkeypatch.setattr(packing, "written", lambda *a: (seen.append(int(spark.conf.get(name))), write(*a))[1])
    assert packing.pack(frame(spark, rows()), WORDS, 256, 0).count() >= len(rows())
    assert seen == [2_000] and spark.conf.get(name) == before


def test_fullest_is_the_best_subset_sum():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room, sums = r.randint(1, 60), {0}
        for k, n in counts.items():
            sums |= {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_token_files(spark):
    data = rows()
    path = fresh_path(spark, "test-files")
    tokenfile.write(frame(spark, data), path, WORDS, 1)
    tok, at = word_encoder(WORDS).tokenizer, 0
    got = {r.doc_id: (r.start, r.ids) for r in tokenfile.read(spark, path).collect()}
    for d, t in sorted(data):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[d] == (at, ids)
        at += len(ids)
    assert {r.doc_id: r.start for r in tokenfile.digests(spark, path).collect()} == {d: s for d, (s, _) in got.items()}


def test_bpe(spark):
    import tiktoken

    c = bpe.codec(RANKS, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    data = rows()
    got = {r.doc_id: r.ids for r in bpe.encode(frame(spark, data), RANKS, P.PATTERN).collect()}
    assert got == {d: lib.encode_ordinary(t or "") for d, t in data}
    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choice("ab cd\n\t'st 12é \x1c\x85　&中🙂́ ") for _ in range(r.randint(0, 30)))
        assert c.encode(s) == lib.encode_ordinary(s) and c.decode(c.encode(s)) == s.encode()


@pytest.mark.parametrize("most", [simhash.MOST, 3, 0])
def test_links_of_fingerprints(spark, most):
    """Whole cells, cells of more than three and all cells parted: the same groups."""
    from loomquill.llm.components import components

    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    even = sum(1 << i for i in range(0, 64, 2))  # one bit in each segment: the fullest cells
    base += [even ^ sum(3 << 2 * i for i in r.sample(range(32), 12)) for _ in range(40)]
    u = np.unique(np.array([b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(4)], np.uint64))
    links = simhash.links(spark.createDataFrame([(int(f), i) for i, f in enumerate(u.view(np.int64))], "fp long, node long"), 4, most)
    root = {x.node: x.component for x in components(links).collect()}
    want = list(range(len(u)))
    for _ in u:
        before = list(want)
        for i in range(len(u)):
            want[i] = min(want[j] for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4))
        if want == before:
            break
    assert [root.get(i, i) for i in range(len(u))] == want


def test_simhash(spark):
    text = "A b C d e é"
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c d", "b c d e", "c d e é")]
    assert simhash.simhash(text) == sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > 3)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows())).collect()}
    assert got[40].fingerprint == "0" * 16 and got[41].component_id <= 40


def test_top_k(spark):
    r = np.random.default_rng(5)
    data = [(i, [float(x) for x in r.integers(-3, 4, 8) / 7]) for i in range(230)] + [(1000, None), (1001, [float("nan")] * 8), (1050, [None] + [1.0] * 7), (1100, [0.5] * 3)]
    got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>"), 5).select("query_id", "rank", "vec_id", "score").collect())
    v = {i: np.floor(256 * np.asarray(e, np.float32).astype(float)).astype(int) for i, e in data[:230]}
    want = []
    for q in range(0, 230, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("weak", [False, True])
def test_fingerprints(spark, weak):
    data = rows()
    form = (lambda c: F.substring(F.hex(F.xxhash64(c)), 1, 1)) if weak else fingerprints.digest
    got = {r.doc_id: r for r in fingerprints.fingerprint(frame(spark, data), form_digest=form).collect()}
    text = {d: t or "" for d, t in data}
    order = sorted(text, reverse=True)
    for d, after in zip(order, order[1:] + order[:1]):
        half = len(text[d]) // 2
        edit = text[d][: len(text[d]) - half] + text[after][:half]
        assert got[d].n_chars == len(text[d]) and got[d].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
    key = lambda s: " ".join(s.casefold().split())
    for a in text:
        for b in text:
            assert (got[a].fingerprint == got[b].fingerprint) == (key(text[a]) == key(text[b]))


def test_models_find_what_is_labelled(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    vocabulary = [word() for _ in range(300)]
    docs, labels = [], []
    for d in range(400):
        toxic, bad = d % 4 == 0, d % 4 == 1
        w = [r.choice(vocabulary) for _ in range(60)]
        if toxic:
            w[20:24] = ["vile", "vileness", "scummy", "vile"]
        docs.append((d, " ".join(x + "&&&" for x in w) if bad else " ".join(w)))
        labels.append((d, int(not bad), int(toxic)))
    docs += [(900, None), (901, "")]
    f, y = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(f, y).collect()}
    assert all(got[d].predicted == t for d, _, t in labels if got[d].held_out) and got[900].predicted == got[901].predicted == 0
    assert any(s.start <= 20 and s.end >= 24 for s in got[0].segments)
    got = {x.doc_id: x for x in quality.classify(f, y).collect()}
    assert all(got[d].predicted == q for d, q, _ in labels if got[d].held_out)


def test_empty_tables(spark):
    e = frame(spark, [])
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (recompression.repeated_words(e), suffixes.repeated_bytes(e), packing.pack(e, WORDS), simhash.near_duplicates(e), bpe.round_trip(e, RANKS, P.PATTERN), fingerprints.fingerprint(e), toxicity.toxicity(e, y), quality.classify(e, y), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.count() == 0
    path = fresh_path(spark, "empty-files")
    tokenfile.write(e, path, WORDS, 1)
    assert tokenfile.read(spark, path).count() == 0


def test_repeated_rows_and_null_ids(spark):
    f = frame(spark, [(1, LONG), (1, LONG), (None, "a b"), (None, None), (2, "a b")])
    assert {r.n_removed for r in suffixes.repeated_bytes(f).where("doc_id = 1").collect()} == {len(LONG)}
    for out in (recompression.repeated_words(f), packing.pack(f, WORDS, 65_536), simhash.near_duplicates(f), fingerprints.fingerprint(f)):
        assert out.count() == 5
