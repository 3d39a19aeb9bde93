"""Token ids of whole texts with a public word-end BPE, one call per distinct word."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words whose ids a worker remembers, and the characters of the longest; when full, it starts afresh. Long words seldom come again. What is
#: remembered stays in the worker until a task lets go of it (workers.let_go).
MAX_WORDS, MAX_CHARS = 300_000, 24
#: Texts of these characters alone are split here; in them white space, letters, digits and lower case mean the same to
#: Python and to the tokenizer, and nothing composes across words. All other texts go to the tokenizer whole.
_PLAIN = re.compile(r"[\t-\r -~\xa1-įı-ɏ]*")
#: Fixed value: the split pattern of the vocabulary.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _remembered(known: dict[str, bytes], word: str, ids: bytes) -> bytes:
    if len(word) <= MAX_CHARS:
        if len(known) >= MAX_WORDS:  # also within one long text
            known.clear()
        known[word] = ids
    return ids


class _Pieces(dict):
    """Packed ids by piece."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, _byte_letters()

    def coded(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        return _remembered(self, piece, self.coded(piece))


class _Words(dict):
    """Packed ids by word between white space."""

    def __init__(self, model) -> None:
        self.pieces = _Pieces(model)

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        # A word that is one piece is remembered once, as a word.
        ids = self.pieces.get(low) or self.pieces.coded(low) if low.isalpha() else b"".join(map(self.pieces.__getitem__, _PIECE.findall(low)))
        return _remembered(self, word, ids)


class WordEncoder:
    """Same ids as `Tokenizer.encode(text, add_special_tokens=False)`, as packed little-endian uint32."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or "<|" in text and any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)
