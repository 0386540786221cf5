"""Whole texts as words and 64-bit word hashes, a few megabytes at a time, inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from lagwise.llm.common import PLAIN_WORDS

CHUNK_BYTES = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word; emptied when it grows large, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(PLAIN_WORDS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, by its start."""
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= _MULTIPLIER
        h += x[j : j + n]
    return mixed(h)


@dataclass
class Chunk:
    """Some whole documents. ``first[i]:first[i + 1]`` are document i's words in ``words`` and ``x``."""

    ids: pa.Array
    texts: list[bytes | None]
    words: list[bytes]
    first: np.ndarray
    rest: list[pa.Array]  # the columns after doc_id and text

    def hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def whole(self, of: np.ndarray, size: int) -> np.ndarray:
        """For each start of ``size`` consecutive words, whether they are in one document."""
        n = max(0, len(of) - size + 1)
        return of[:n] == of[size - 1 : size - 1 + n]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of whole rows with about ``limit`` bytes of text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def chunks(batches: Iterator[pa.RecordBatch], split=bytes.split, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Arrow batches of ``doc_id, text, ...`` cut into runs of whole documents of about ``limit`` bytes."""
    for b in slices(batches, 1, limit):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        words: list[bytes] = []
        first = [0]
        for t in texts:
            if t:
                words += split(t)
            first.append(len(words))
        yield Chunk(b.column(0), texts, words, np.array(first), [b.column(i) for i in range(2, b.num_columns)])
