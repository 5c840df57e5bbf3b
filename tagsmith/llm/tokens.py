"""Token ids of whole texts by a public BPE vocabulary whose pieces are words, with a cache of pieces.

The vocabulary's file normalises (NFC, white space, lower case), splits by a pattern and merges inside each piece;
pieces are independent, so the ids of a text are those of its pieces, and most pieces recur. Texts with characters
whose class or case could differ between the library's tables and Python's go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

#: Words and pieces kept in each cache; a cache is emptied when full.
CACHE = 400_000

_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Characters outside the ranges where both agree: Latin letters without superscript digits and fractions, general
#: punctuation; the separators 1C to 1F are white space only to Python.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class WordBpe:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self.tokenizer)
        self.words = _Words(self.pieces)

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
            if _OTHER.search(text):
                return self.whole(text)
        # no piece spans white space, so words can be looked up as they are
        out = b"".join(map(self.words.__getitem__, text.lower().split()))
        for cache in (self.words, self.pieces):
            if len(cache) > CACHE:
                cache.clear()
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Words(dict):
    def __init__(self, pieces: dict):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        out = self[word] = b"".join(map(self.pieces.__getitem__, _SPLIT.findall(word)))
        return out


class _Pieces(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        spelt = "".join(map(self.letters.__getitem__, piece.encode()))
        out = self[piece] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return out
