"""Ids by a tokenizers file, word by word: white space always parts tokens there, so the ids of a text are those of its words in turn."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from .common import kept

#: Entries of each worker's memories of words and of pieces; each is emptied when full.
MEMO = 450_000
#: Characters of texts whose new words are asked for together, at least.
GROUP = 1 << 18

#: Characters that str.split takes for white space and the tokenizer doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: ASCII and the Latin letters up to U+017F that composition leaves alone and of which lower case is one letter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿā-ſ]+|[0-9]|[^\\sa-zß-öø-ÿā-ſ0-9]+")
_PIECE_OR_BLANK = re.compile(_PIECE.pattern + "| ")
_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")
_TRIES_PLAIN = ["It's a  test\n of 12 words, isn't\tit? ##a1b22", "Été ÀÖØöøıſžŁ 'll 's re'd x'Re ''s Straße's ħÿ", "!\"#$%&'()*+,-./ :;<=>?@[\\]^_`{|}~ 0123456789"]
#: The character that byte-level tokenizers write for each byte, as UTF-16; the blank stays, as it parts pieces.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = np.zeros(256, "<u2")
_BYTE_CHARS[_SHOWN] = _SHOWN
_BYTE_CHARS[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
_BYTE_CHARS[32] = 32
_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    Holds for tokenizers whose pre-tokenizer drops white space and never joins across it, which `check`
    tries on the file at hand; for others each whole text is passed to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets
        self.most = MEMO
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[0] if special else (-1, "")
        self.specials = [s for _, s in special]
        self.by_word = bool(special) and self.check(lambda t: [w for w in _BLANK.split(t) if w])
        # Words are cut into pieces only where the file's own pre-tokenizer does the same.
        self.pieced = self.by_word and self.short_way() and all(self.whole(t) == self.by_pieces(t) for t in _TRIES_PLAIN)
        self.pieces.clear()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def check(self, cut) -> bool:
        tries = ["It's a  test\n of 12 words, isn't\tit? ##a1b22", "Été é ́x  'll 's re'd x'Re ''s Straße's", "が ゙a 中文 x, y.z"]
        return all(self.whole(t) == b"".join(self.whole(w) for w in cut(t)) for t in tries)

    def add(self, new: set[str], marked: bool) -> None:
        """Words of plain Latin characters are cut into the pre-tokenizer's pieces, which many words share; others go whole."""
        pieces, memo = self.pieces, self.memo
        plain = list(filter(_PLAIN.fullmatch, new)) if self.pieced else []
        if marked:
            plain = [w for w in plain if not self.special(w)]
        whole = list(new.difference(plain)) if len(plain) < len(new) else []
        if plain:
            cut = _PIECE_OR_BLANK.findall(" ".join(plain).lower())
            parts = set(cut)
            missing = [p for p in parts if p not in pieces]
            if len(pieces) + len(missing) > self.most:
                pieces.clear()
                missing = list(parts)
            self.ask_pieces([p for p in missing if p != " "])
            pieces[" "] = b""  # the only one without ids
            ids = list(map(pieces.__getitem__, cut))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.append(np.cumsum(sizes)[sizes == 0], sizes.sum()).tolist()
            raw, start = b"".join(ids), 0
            for w, end in zip(plain, ends, strict=True):
                memo[w] = raw[start:end]
                start = end
        if whole:
            self.ask_words(whole)

    def special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def ask_pieces(self, new: list[str]) -> None:
        """Pieces part at blanks and each ends with a token that marks a word's end, so ids of many come from one call."""
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            joined = np.frombuffer(" ".join(some).encode(), np.uint8)
            ids = np.asarray(self.short_many([_BYTE_CHARS[joined].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, (np.flatnonzero(self.ends[ids]) + 1).tolist(), strict=True):
                self.pieces[p] = raw[4 * start : 4 * end]
                start = end

    def ask_words(self, new: list[str]) -> None:
        """The library encodes many in one call, parted by a special token that none of them holds."""
        odd = [w for w in new if self.special(w)]
        for w in odd:
            self.memo[w] = self.whole(w)
        new = list(set(new).difference(odd)) if odd else new
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.asarray(self.many([self.mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, cuts, strict=True):
                self.memo[w] = raw[4 * start : 4 * end]
                start = end + 1

    def short_way(self) -> bool:
        """A tokenizer of the same model without normalizer and patterns, for pieces that are through both; false if the model has no word ends."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return False
        short = Tokenizer(self.tokenizer.model)
        short.normalizer, short.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.short_many = getattr(short, "encode_batch_fast", short.encode_batch)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return True

    def by_pieces(self, text: str) -> bytes | None:
        """The text's ids by way of pieces alone, for the check; None where the pieces can't be told apart."""
        parts = [p for w in text.split() for p in _PIECE.findall(w.lower())]
        self.pieces.clear()
        try:
            self.ask_pieces(list(set(parts)))
        except (ValueError, IndexError):
            return None
        return b"".join([self.pieces[p] for p in parts])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in turn. New words of some texts, about GROUP characters, are asked for together."""
        if not self.by_word:
            yield from map(self.whole, texts)
            return
        group, size, marked = [], 0, False
        for text in texts:
            odd = any(c in text for c in _ODD)
            parts = [p for p in _BLANK.split(text) if p] if odd else text.split()
            group.append(parts)
            size += len(text)
            marked = marked or self.special(text)
            if size >= GROUP:
                yield from self.encode_words(group, marked)
                group, size, marked = [], 0, False
        yield from self.encode_words(group, marked)

    def encode_words(self, group: list[list[str]], marked: bool) -> list[bytes]:
        """marked: some text of the group holds a special token's string, so words are tried for it."""
        memo, found, gaps, new = self.memo, [], [], set()
        had_gc = gc.isenabled()
        gc.disable()  # a group makes many lists and no cycles
        try:
            for parts in group:
                ids = list(map(memo.get, parts))
                found.append(ids)
                if None in ids:
                    at = [i for i, v in enumerate(ids) if v is None]
                    gaps.append((parts, ids, at))
                    new.update([parts[i] for i in at])
            if new:
                if len(memo) + len(new) > self.most:
                    memo.clear()
                self.add(new, marked)
                for parts, ids, at in gaps:
                    for i in at:
                        ids[i] = memo[parts[i]]
            return [b"".join(ids) for ids in found]
        finally:
            if had_gc:
                gc.enable()


def word_encoder(path: str, most: int = MEMO) -> WordEncoder:
    """The process's encoder for a file; most bounds the entries of each of its memories from now on."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    if most < _loaded[path].most:
        forget()
    _loaded[path].most = most
    return _loaded[path]


def forget() -> None:
    for encoder in _loaded.values():
        encoder.memo.clear()
        encoder.pieces.clear()


kept.append(forget)
