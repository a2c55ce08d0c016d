"""Words and their hashes over whole Arrow batches, as numpy arrays.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D); these bytes
never occur inside a multi-byte UTF-8 character, so byte runs and code-point runs agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for terms: every ASCII byte but letters and digits.
NOT_TERM = np.zeros(256, dtype=bool)
NOT_TERM[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE_WORD = 0x9E3779B97F4A7C15 | 1
_BASES_RUN = (0xD1B54A32D192ED03 | 1, 0xABC98388FB8FAC03 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        known = _powers[base] = (out[0], out[1])
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Some consecutive rows of a batch: their bytes, and the bounds of each row's words."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def word_offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES, apart: np.ndarray = _SPACE) -> Iterator[Chunk]:
    """Rows in runs of about ``size`` bytes (a longer row alone); null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        part = data[offsets[at] : offsets[to]]
        yield split_words(at, _LOWER[part] if lower else part, own, apart)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what it keeps adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def split_words(first: int, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> Chunk:
    solid = ~apart[data]
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Chunk(first, rows, data, offsets, none, none, np.zeros(rows, np.int64))
    begins, finishes = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[begins] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[finishes - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return Chunk(first, rows, data, offsets, starts, ends, counts)


def word_hashes(c: Chunk) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
    return span_hashes(c, c.starts, c.ends)


def span_hashes(c: Chunk, *bounds: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans between pairs of bounds (starts, ends, starts, ends, ...), one after another."""
    up, down = powers(_BASE_WORD, len(c.data) + 1)
    total = np.empty(len(c.data) + 1, np.uint64)
    total[0] = 0
    part = _BYTE[c.data]
    part *= up[: len(c.data)]
    np.cumsum(part, out=total[1:])
    out = []
    for starts, ends in zip(bounds[::2], bounds[1::2], strict=True):
        h = (total[ends] - total[starts]) * down[starts]
        out.append(mix(h + (ends - starts).astype(np.uint64)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def run_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``k`` consecutive words, run i starting at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_BASES_RUN[which], len(words) + 1)
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def run_starts(counts: np.ndarray, k: int) -> np.ndarray:
    """First words of the runs of ``k`` words that stay inside one row."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(len(ends)) + k <= ends)
