"""Vectorised byte-level text helpers shared by the corpus operators.

Everything here works on Arrow string columns as flat UTF-8 byte buffers, so that a
batch of documents costs a fixed number of numpy passes and no per-word Python.
Memory is proportional to one chunk (``CHUNK`` bytes, or one longer document).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that belong to words: ASCII letters, digits and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The same without digits.
LETTER_BYTES = WORD_BYTES.copy()
LETTER_BYTES[48:58] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        grown = []
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            grown.append(np.multiply.accumulate(table))
        _powers, _inverses = grown
    return _powers[:n], _inverses[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive documents of at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums s with s[0] = 0, from which span_hash() takes the hash of any byte span."""
    powers, _ = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans have equal hashes."""
    _, inverses = _power_tables(len(sums))
    return mix((sums[end] - sums[start]) * inverses[start])


class Tokens:
    """Words of a chunk of documents: byte spans, document index and 64-bit hash of each."""

    __slots__ = ("counts", "doc", "end", "hash", "start", "sums")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTES) -> None:
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = member[data]
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        opens[cut] = inside[1:-1][cut]
        closes[cut - 1] = inside[1:-1][cut - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.sums = prefix_hash(data)
        self.hash = span_hash(self.sums, self.start, self.end)
        first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


def term_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to terms, where terms start and where they end; a document's end ends a term."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    own = inside[1:-1]
    starts, ends = own & ~inside[:-2], own & ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cut] = own[cut]
    ends[cut - 1] = own[cut - 1]
    return own, np.flatnonzero(starts), np.flatnonzero(ends) + 1


def terms_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTES) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of some documents, ASCII letters lowered, and of each occurrence the term's place among them and the document."""
    inside, start, end = term_spans(data, offsets, member)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]])))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets, start, "right") - 1


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Unicode lower case of a string column; null stays null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column)


_held: dict[str, object] = {}


def held(key: str, build: Callable[[], object]) -> object:
    """A table that a Python worker keeps between tasks of one operator, built at its first use."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def let_go() -> None:
    """Forget what another operator has held in this worker: workers are kept and reused."""
    _held.clear()


def release() -> None:
    """Give memory that a finished task has freed back to the system: Python workers are kept and reused."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
