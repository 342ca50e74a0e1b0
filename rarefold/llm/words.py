"""Words of a whole Arrow string column at once, as NumPy arrays.

A batch's texts lie one after the other in one byte buffer, so words, word
hashes and n-word window hashes of all of its documents come from a few passes
over that buffer instead of a Python loop over words. Texts are taken in
chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), which
bounds a task's memory by the chunk, not by the batch.

Hashes: a word's is a polynomial of its bytes modulo 2^64, finished by a
64-bit mixer; a window's is a linear form of its words' hashes with odd
multipliers, mixed again. They depend on the words only, never on the
process, so lost tasks give the same values when they run again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)                       # odd
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc's; other C libraries have none


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        out = []
        for base in (_P, _P_INV):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        if size > 4 * CHUNK:          # one very long text: not kept
            return out
        _powers[:] = out
    return _powers


@dataclass
class Words:
    """Words of documents ``first .. first + n_docs`` of a batch.

    ``start``/``end`` are byte positions in ``data``; ``at[i] : at[i + 1]`` are
    the words of the chunk's document ``i``."""
    first: int
    n_docs: int
    data: np.ndarray          # the chunk's bytes (lower-cased A-Z if asked for)
    doc_start: np.ndarray     # n_docs + 1 byte positions
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    raw: np.ndarray           # the bytes as they came
    total: np.ndarray         # n + 1 running sums of the bytes' polynomial

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of any byte ranges of ``data``; of a whole word, its hash."""
        with np.errstate(over="ignore"):
            down = _power_tables(len(self.data) + 1)[1]
            return mix((self.total[end] - self.total[start]) * down[start] + (end - start).astype(np.uint64))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words that start at each word, and whether all of
        them are in the word's document."""
        return window_hash(self.hash, n), self.fits(n)

    def fits(self, n: int) -> np.ndarray:
        left = np.repeat(self.at[1:], np.diff(self.at)) - np.arange(len(self.hash))
        return left >= n


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Mixed linear form of ``n`` consecutive word hashes; the last ``n - 1``
    entries cover fewer words and are meaningless."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h), dtype=np.uint64)
        mult = np.uint64(1)
        for i in range(min(n, len(h))):
            out[: len(h) - i] += h[i:] * mult
            mult = mult * np.uint64(0xD1342543DE82EF95)
        return mix(out + np.uint64(n))


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 byte positions of an Arrow string array (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    pos = np.frombuffer(offs, dtype=np.int64)[col.offset: col.offset + len(col) + 1] \
        if offs is not None and len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, pos


def chunks(col, lower: bool = False, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """``Words`` of the column, about ``CHUNK`` bytes of whole texts at a time.
    ``space`` flags the bytes that part words (white space of ASCII)."""
    raw, pos = utf8(col)
    n, i = len(pos) - 1, 0
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(pos, pos[i] + CHUNK, side="right")) - 1)
            yield _words(raw[pos[i]:pos[j]], pos[i:j + 1] - pos[i], i, lower, space)
            i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system. Spark keeps Python workers for later
    stages, and what an idle one holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _words(data: np.ndarray, doc_start: np.ndarray, first: int, lower: bool, space: np.ndarray) -> Words:
    raw = data
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[doc_start] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1] if n else False
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1] if n else False
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(n + 1)[0][:n], out=total[1:])
    w = Words(first, len(doc_start) - 1, data, doc_start, start, end,
              np.searchsorted(start, doc_start), start, raw, total)
    w.hash = w.span_hash(start, end)
    return w
