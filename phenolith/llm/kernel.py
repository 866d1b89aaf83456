"""Vectorised word kernel over Arrow string columns.

Texts stay in Arrow's byte buffer; words are found, lower-cased and hashed with
numpy, without making a Python object for each word.  Work goes in slices of
about ``SLICE`` bytes, so memory is bounded whatever the batch size; one text is
never cut, so the bound is the larger of SLICE and the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A word byte is a digit, a letter a-z (after lower-casing) or any byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
#: Everything but the space and \t \n \v \f \r.
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False

#: Random 64-bit numbers for each byte at each place modulo ``PLACES`` of a word.
PLACES = 64
_TABLE = np.random.default_rng(0x5EED).integers(0, 1 << 64, PLACES * 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that each slice has about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, 64-bit hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1
    total: np.ndarray  # running sums that hashes of words and of their beginnings come from

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def head(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of more than n bytes, hashes of their first n bytes)."""
        at = np.flatnonzero(self.end - self.start > n)
        begin = self.start[at]
        return at, mix(self.total[begin + n] - self.total[begin] + _U(n << 32))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(col: pa.Array, is_word: np.ndarray) -> Words:
    """Split each text into maximal runs of ``is_word`` bytes, A-Z lower-cased."""
    raw, off = buffers(col)
    data = _LOWER[raw]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(off), np.int64), np.zeros(1, np.uint64))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[raw]
    edge = off[(off > 0) & (off < n)]
    begins = inside[1:-1] & ~inside[:-2]
    begins[edge] = inside[1:-1][edge]
    stops = inside[1:-1] & ~inside[2:]
    stops[edge - 1] = inside[1:-1][edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    size = end - start
    at = np.flatnonzero(inside[1:-1])
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)  # of each byte in its word
    value = _TABLE[(place % PLACES << 8) | data[at]]
    if len(size) and size.max() > PLACES:
        value *= mix((place // PLACES).astype(np.uint64)) | _U(1)  # 1 for the first PLACES bytes
    total = np.zeros(n + 1, np.uint64)
    total[at + 1] = value
    np.cumsum(total, out=total)
    return Words(data, start, end, mix(total[end] - total[start] + size.astype(np.uint64)), np.searchsorted(start, off), total)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each position; positions past the end are left out."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = 1
    for j in range(n):
        out += h[j : j + m] * _U(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
    return mix(out + _U(n))


def rolling(x: np.ndarray, w: int, reduce: np.ufunc) -> np.ndarray:
    """reduce over x[i : i + w] for each i, by doubling."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have < w:
        step = min(have, w - have)
        x = reduce(x[: len(x) - step], x[step:])
        have += step
    return x


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first[i] : first[i] + count[i]: (i, element), concatenated."""
    total = int(count.sum())
    owner = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return owner, np.arange(total) - begin[owner] + first[owner]
