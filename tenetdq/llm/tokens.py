"""Byte-level BPE ids of whole texts, for use inside Arrow tasks.

The ids are those the ``tokenizers`` library gives for the whole text. The pre-tokenizer of these
vocabularies never joins what stands left and right of a space that is followed by a non-white
character, so a text is cut there; each distinct piece is looked up in a bounded cache per
worker, and only pre-tokens that no earlier text had reach the library, many in one call. Texts
in which a space is followed by white space, or which hold an added token of the vocabulary, are
encoded whole.
"""
from __future__ import annotations

import os

import numpy as np
import regex

from tenetdq.llm.common import own_cache

CACHE_PIECES = 300_000         # pieces kept per worker and generation: 21 % of a corpus' words miss, 78 MB
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The published pre-tokenizer pattern of byte-level BPE vocabularies (a fixed value).
PRE_TOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class _Letters(dict):
    """How byte-level BPE vocabularies write a character: one printable letter for each byte."""

    def __init__(self):
        super().__init__()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {b: chr(b) for b in kept}
        byte |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in byte)}
        self._byte = byte

    def __missing__(self, char: str) -> str:
        out = self[char] = "".join(self._byte[b] for b in char.encode())
        return out


class _Pieces(dict):
    """Piece after a space -> its ids, or False where it can't stand alone. Full, it starts anew and keeps the generation before."""

    def __init__(self, encoder: Encoder, cap: int):
        super().__init__()
        self.encoder, self.cap, self.old = encoder, cap, {}

    def __missing__(self, piece: str) -> bytes | bool:
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            word = piece.rstrip(PUNCTUATION)
            if word.isalpha():                               # one pre-token, perhaps with an end
                if len(word) < len(piece):
                    ids = self[word] + self.encoder.end(piece[len(word):])
                else:
                    ids = self.encoder.word(word)
            elif not piece or piece[0].isspace():
                ids = False
            else:
                ids = b"".join(map(self.encoder.end, PRE_TOKENS.findall(" " + piece)))
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian 32-bit ids, one ``bytes`` per text."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._merge = self._tok.model.tokenize
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._raw = [i.to_bytes(4, "little") for i in range(self._tok.get_vocab_size())]
        self._letters = _Letters()
        self._ids = _Pieces(self, pieces).__getitem__
        self._ends: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self._tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _pre_token(self, part: str) -> bytes:
        """Ids of one pre-token, by the library's merge model."""
        shown = "".join(map(self._letters.__getitem__, part))
        raw = self._raw
        return b"".join([raw[t.id] for t in self._merge(shown)])

    def word(self, word: str) -> bytes:
        """Ids of a space and a word of letters."""
        if word.isascii():
            raw = self._raw
            return b"".join([raw[t.id] for t in self._merge("Ġ" + word)])
        return self._pre_token(" " + word)

    def end(self, end: str) -> bytes:
        ids = self._ends.get(end)
        if ids is None:
            if len(self._ends) > 20_000:
                self._ends.clear()
            ids = self._ends[end] = self._pre_token(end)
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._encode(t) if t else b"" for t in texts]

    def _encode(self, text: str) -> bytes:
        for added in self._added:
            if added in text:
                return self._whole(text)
        first, *pieces = text.split(" ")
        try:
            rest = b"".join(map(self._ids, pieces))
        except TypeError:                                    # holds an unsafe piece
            return self._whole(text)
        return b"".join(map(self.end, PRE_TOKENS.findall(first))) + rest


def encoder(path: str, pieces: int = CACHE_PIECES) -> Encoder:
    """The encoder that a Python worker keeps."""
    return own_cache(("tokens", path, pieces), lambda: Encoder(path, pieces))
