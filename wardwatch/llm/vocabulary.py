"""Byte-level BPE ids by the tokenizers library, with a bounded cache of frequent pieces."""

from __future__ import annotations

import ctypes
import gc
import re
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

# Letters that end no run early: each is a letter to the vocabulary's own splitter too.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[ \t-\r]?+[{LETTERS}]++|[^{LETTERS}]+?(?=[ \t-\r]?+[{LETTERS}]|\Z)", re.S)
# Apostrophes and all but LETTERS and \x00-\x1b\x20-\x7e; listed, as a search for listed characters takes half the time.
ODD = re.compile("['\x1c-\x1f\x7f-¿×÷ɐ-\U0010ffff]")
SPACED = re.compile(r"(?<=[!-~])(?= [!-~])")
WORD = re.compile(rf" ?[{LETTERS}]++\Z")
ID = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


def _smallest(tokenizer: Tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 65536 else "<u4")


def id_type(path: str) -> np.dtype:
    """The type that holds every id of a vocabulary."""
    return _smallest(Tokenizer.from_file(path))


class Encoder(dict):
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text is cut only where the vocabulary's splitter always cuts, so its ids are those
    of its pieces in a row. The ids of up to twice ``limit`` pieces are remembered: when
    one generation is full it becomes the former one, from which pieces met again return.
    Texts with apostrophes or unusual characters are cut at single spaces alone, and those
    that hold an added token of the vocabulary not at all.
    """

    def __init__(self, path: str, limit: int = 180_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = _smallest(self.tokenizer)
        self.limit = limit
        self.former: dict[str, bytes] = {}
        self._letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.former = dict(self)
            self.clear()
        value = self.former.get(piece)
        if value is not None:
            self[piece] = value
            return value
        if WORD.match(piece):
            ids = map(ID, self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self._letters)))
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        value = self[piece] = array(self.dtype.char, ids).tobytes()
        return value

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pieces(self, text: str | None) -> list[str] | None:
        """The pieces of a text; None if it must be encoded as a whole."""
        if not text:
            return []
        if any(t in text for t in self.added):
            return None
        return SPACED.split(text) if ODD.search(text) else PLAIN.findall(text)

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian integers of ``dtype``; null has none."""
        pieces = self._pieces(text)
        return self._whole(text) if pieces is None else b"".join(map(self.__getitem__, pieces))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str, limit: int = 180_000) -> Encoder:
    """One encoder per Python worker and vocabulary. A new word costs some 50 times what a
    remembered one does, and takes about 200 bytes in each generation."""
    return Encoder(path, limit)


def release_memory() -> None:
    """Give back what a reused Python worker still holds of an earlier operator: its
    encoders, Arrow's spare memory, and, where the C library can, freed heap."""
    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
