"""The word-by-word encoder against the library on whole texts."""

import random

import public_tokenizers as P
import pytest

from loomquill.llm import words

ODD = ["", " ", "It's we'LL x're", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "é Été İi ıſ", "\x1ca\x1db\x1e\x1f", "中文　x が", "12 345 ٣", "\x85a b", "''s'T", "\U0001f600️ ok\x00z"]


@pytest.mark.parametrize("memo,group", [(words.MEMO, words.GROUP), (40, 1), (40, 400)])
def test_encoder(monkeypatch, memo, group):
    monkeypatch.setattr(words, "MEMO", memo)
    monkeypatch.setattr(words, "GROUP", group)
    w, r = words.WordEncoder(P.path("word_bpe_49k.json")), random.Random(5)
    assert w.by_word and w.pieced
    letters = "abcXYZéÄž019'!?.-_<|>а中"
    made = [" ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts = [x for i, t in enumerate(made) for x in (t, ODD[i % len(ODD)], t + "\t" + ODD[i % len(ODD)])]
    assert list(w.encode_all(texts)) == [w.whole(t) for t in texts]
    assert [w.encode(t) for t in ODD] == [w.whole(t) for t in ODD]


def test_another_file():
    """A file without word ends is passed to the library whole."""
    w = words.WordEncoder(P.path("byte_bpe_50k.json"))
    texts = [*ODD, "plain words  here\n\n and there"]
    assert list(w.encode_all(texts)) == [w.whole(t) for t in texts]


def test_memories_are_bounded_by_what_is_asked_for(monkeypatch):
    monkeypatch.setattr(words, "GROUP", 500)
    path = P.path("word_bpe_49k.json")
    r = random.Random(8)
    texts = [" ".join(f"w{r.randint(0, 5000)}x" for _ in range(40)) for _ in range(300)]
    w = words.word_encoder(path, 200)
    assert list(w.encode_all(texts)) == [w.whole(t) for t in texts]
    assert len(w.memo) <= 200 and len(w.pieces) <= 201
    assert words.word_encoder(path).most == words.MEMO
