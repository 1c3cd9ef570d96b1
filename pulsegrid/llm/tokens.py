"""Tokenizing columns of text with the tokenizers library, one remembered word at a time."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

#: White space beyond the plain kinds, on which Python and the tokenizer's patterns may disagree.
_WIDE = (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(map(chr, _WIDE)) + "]")
#: Words, and pieces of words, that a worker remembers, for vocabularies without and with spaces in
#: words; with more it starts anew, so its memory stays bounded (about 200 and 350 MB).
CACHE_WORDS = {False: 700_000, True: 1_000_000}
CACHE_PIECES = 200_000
#: Letters and numbers among the characters up to U+00FF, and the splitters of both vocabularies for such words.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_SPLIT = {
    True: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    False: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
}


def _byte_chars() -> dict[int, int]:
    """The characters that byte-level vocabularies write bytes as: visible ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(other)}


class _Words(dict):
    """Encodes a word when it is first looked up."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordCache:
    """Ids of texts as little-endian uint16 bytes, equal to encoding the whole text.

    Both vocabularies split a text before they merge, and never across a space that a
    character other than white space follows.  So a text is cut at such spaces, every new
    word is encoded once, and its ids are remembered.  ``spaced``: words keep their space
    (byte-level vocabularies); else white space is dropped (word vocabularies).  Texts with
    rarer white space, runs of spaces or the string of an added token are encoded whole, so
    that such strings become those tokens as in the library's plain call.  Words of characters
    up to U+00FF are split here, others by the tokenizer's own normalizer and splitter; pieces
    go to its model.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        #: Texts with one of these are encoded whole; NUL marks the first word of a text.
        self.whole = ("\0", *(t.content for t in self.tok.get_added_tokens_decoder().values()))
        self.model = self.tok.model
        self.spaced = spaced
        self.words = _Words(self._word)
        self.pieces = _Words(self._piece)
        self.chars = _byte_chars()

    def _encode(self, text: str) -> bytes:
        ids = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return array("H", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece of characters up to U+00FF."""
        shown = piece.encode().decode("latin-1").translate(self.chars)
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # what most words are: one piece
            shown = "\u0120" + word if self.spaced else word.lower()
            return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if word[-1:] in (",", ".") and word[:-1].isalpha() and max(word) <= "ÿ":  # two pieces, the first maybe known
            return self.words[word[:-1]] + self.pieces[word[-1]]
        if self.spaced:
            word = word[1:] if word[:1] == "\0" else " " + word
        if not word:
            return b""
        if max(word) <= "ÿ":
            pieces = _SPLIT[self.spaced].findall(word if self.spaced else word.lower())
            return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))
        if self.tok.normalizer is not None:
            word = self.tok.normalizer.normalize_str(word)
        shown = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(word)]
        return array("H", [t.id for p in shown for t in self.model.tokenize(p)]).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        if _RARE.search(text) or any(w in text for w in self.whole):
            return None
        if not self.spaced:
            return text.split()
        if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1:] == " ":
            return None
        first, *rest = text.split(" ")
        return ["\0" + first, *rest]  # the first word has no space before it

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if len(self.words) > CACHE_WORDS[self.spaced]:
                self.words.clear()
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            words = self._cut(text)
            yield self._encode(text) if words is None else b"".join(map(self.words.__getitem__, words))


assert sys.byteorder == "little", "ids are written as they stand in memory"

_caches: dict[tuple[str, bool], WordCache] = {}


def word_cache(path: str, spaced: bool) -> WordCache:
    """The cache of this worker; tasks that follow find it filled."""
    if (path, spaced) not in _caches:
        _caches[path, spaced] = WordCache(path, spaced)
    return _caches[path, spaced]
