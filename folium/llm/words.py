"""Words of whole texts as bytes and as 64-bit codes, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_UPPER, _LOWER = range(65, 91), range(97, 123)
SEGMENT = 1 << 20


def letters(digits: bool) -> bytes:
    """A table for bytes.translate: A-Z in lower case, a-z, everything beyond ASCII and, if asked for, digits stay; the rest is blank."""
    kept = {*_LOWER, *range(128, 256), *(range(48, 58) if digits else ())}
    return bytes(b + 32 if b in _UPPER else b if b in kept else 32 for b in range(256))


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text."""
    return column.cast(pa.binary()).to_pylist()


def segments(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each SEGMENT bytes or so; no word is cut."""
    at = 0
    while at < len(raw):
        end = at + SEGMENT
        while end < len(raw) and table[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(table).split()
        at = end


class Codes(dict):
    """Hashes of words, the same in every process; the memory of words seen is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
