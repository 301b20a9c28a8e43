"""Words and word n-grams of many texts at once, as numpy arrays over UTF-8 bytes.

A chunk of texts is joined into one byte array; words are runs of bytes that a table marks.
Every byte of a multi-byte character is 0x80 or above, so tables over bytes describe words of
whole characters. Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def byte_table(marked: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(marked)] = True
    return table


#: digits, a-z and every character outside ASCII
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: whatever is no blank, tab or line break
SOLID = ~byte_table([0x20, *range(0x09, 0x0E)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = -(-n // 65_536) * 65_536 + 65_536  # a little more, as the next chunk may be a little longer
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values (the finisher of a well-known public hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a chunk: ``data[starts[i]:ends[i]]`` is word i, of text ``text[i]``.

    Words of text t are those from ``bounds[t]`` to ``bounds[t + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def string(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line break after each, and the place where each begins."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=begins[1:])
    return data, begins


def words_of(texts: list[bytes], table: np.ndarray, lower: bool = True) -> Words:
    """Runs of marked bytes. The line break between texts must not be marked."""
    data, begins = joined(texts)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Words(data, starts, ends, np.searchsorted(starts, begins))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, whatever text they are of."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        factor = pow(_BASE, 2 * k + 1, 1 << 64) & _MASK
        total += hashes[k : k + size] * np.uint64(factor)
    return mix(total + np.uint64(n))


def ngram_inside(words: Words, n: int) -> np.ndarray:
    """For each n-gram, whether all its words are of one text."""
    text = words.text()
    return text[: len(text) - n + 1] == text[n - 1 :] if len(text) >= n else np.empty(0, bool)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with about ``limit`` bytes of text, one row at least, with the texts."""
    for batch in batches:
        texts = batch.column(column)
        begin, size = 0, 0
        for i, more in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if i > begin and size + more > limit:
                yield batch.slice(begin, i - begin), text_bytes(texts.slice(begin, i - begin))
                begin, size = i, 0
            size += more
        if begin < batch.num_rows:
            yield batch.slice(begin), text_bytes(texts.slice(begin))
