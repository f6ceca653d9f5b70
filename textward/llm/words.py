"""Vectorised word splitting and 64-bit word hashing over Arrow string batches.

A word is a maximal run of bytes other than space and \\x09-\\x0D; A-Z count as a-z.
The hash of a word depends on its (lower-cased) bytes alone, so it is the same in every
task, executor and run.  Words are told apart by their 64-bit hashes: among 10**9
distinct words the odds of any collision are about 1 in 40.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a worker's temporary arrays hold eight bytes for each.
PIECE_BYTES = 1 << 19
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = (0x20, *range(0x09, 0x0E))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    """True for bytes that belong to words."""
    t = np.ones(256, dtype=bool)
    t[list(_SPACES)] = False
    return t


def alnum_table() -> np.ndarray:
    """True for ASCII letters and digits and for all bytes of other characters."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


class _Tables:
    def __init__(self) -> None:
        self.lower = lower_table()
        self.inside = space_table()
        self.alnum = alnum_table()
        self.code = mix(self.lower.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        self.exact = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))  # cases told apart
        self.power = self.inverse = np.ones(0, dtype=np.uint64)

    def powers(self) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base, and of its inverse, for the bytes of a piece."""
        if len(self.power) != PIECE_BYTES:
            self.power = _geometric(_BASE, PIECE_BYTES)
            self.inverse = _geometric(pow(_BASE, -1, 1 << 64), PIECE_BYTES)
        return self.power, self.inverse


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


TABLES = _Tables()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def bounds(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word; no word crosses a row's offset."""
    m = inside[raw]
    before = np.empty(len(m) + 1, dtype=bool)
    before[0] = False
    before[1:] = m
    after = before[1:].copy() if len(m) else m
    cut = offs[(offs > 0) & (offs < len(m))]
    before[cut] = False
    starts = np.flatnonzero(m & ~before[:-1])
    nxt = np.empty(len(m), dtype=bool)
    if len(m):
        nxt[:-1] = after[1:]
        nxt[-1] = False
        nxt[cut - 1] = False
    ends = np.flatnonzero(m & ~nxt) + 1
    return starts, ends


def _values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The polynomial of each byte range of a piece; a longer range's is the sum of its parts' (see `_joined`)."""
    power, inverse = TABLES.powers()
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(code[raw] * power[: len(raw)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts % PIECE_BYTES]


def _joined(value: int, length: int, more: int) -> int:
    """The polynomial of `length` bytes with another's behind them."""
    return (value + more * pow(_BASE, length, 1 << 64)) & _M


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte range (ascending, apart from each other, none empty)."""
    code = TABLES.code if code is None else code
    sums = np.zeros(len(starts), np.uint64)
    for at in range(0, len(raw), PIECE_BYTES):
        part = raw[at : at + PIECE_BYTES]
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        if low == high:
            continue
        a, b = np.maximum(starts[low:high] - at, 0), np.minimum(ends[low:high] - at, len(part))
        got = _values(part, a, b, code)
        if starts[low] < at:  # goes on from the piece before
            got[0] = _joined(int(sums[low]), at - int(starts[low]), int(got[0]))
        sums[low:high] = got
    return mix(sums + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offs: np.ndarray, spans: bool = False, inside: np.ndarray | None = None, code: np.ndarray | None = None):
    """Hashes of all words in order, and the offset of each row in them.

    With spans, also the start and end byte of each word in raw. inside: other bytes to make up words;
    code: other codes of bytes.
    """
    starts, ends = bounds(raw, offs, TABLES.inside if inside is None else inside)
    hashes = hash_spans(raw, starts, ends, code)
    rows = np.searchsorted(starts, offs, "left")
    rows[-1] = len(starts)
    return (hashes, rows, starts, ends) if spans else (hashes, rows)


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of h; len(h) - n + 1 of them."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + size]
    return mix(out + np.uint64(n))


def windows(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions 0..total-n, those whose n entries lie in one row, and their offsets by row."""
    counts = np.maximum(np.diff(rows) - n + 1, 0)
    out = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=out[1:])
    total = int(out[-1])
    at = np.arange(total, dtype=np.int64) + np.repeat(rows[:-1] - out[:-1], counts)
    return at, out


def slices(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about `limit` bytes each (a longer row stands alone)."""
    _, offs = utf8(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt, _LIBC.malloc_trim  # noqa: B018 - looked up here
except (OSError, AttributeError):  # another C library: freed memory is given back as that one sees fit
    _LIBC = None
_M_MMAP_THRESHOLD, _MAPPED = -3, 1 << 22


def _begin() -> None:
    if _LIBC:
        _LIBC.mallopt(_M_MMAP_THRESHOLD, _MAPPED)


def _end() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for a worker that lives on: arrays go back to the system when freed, and the rest when the task ends.

    Workers serve task after task; what allocators hold back for later would count against the
    executor's memory for good.
    """

    @wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from run(batches)
        finally:
            _end()

    return outer
