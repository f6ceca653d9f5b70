"""HyperMinHash signatures of shingle sets.

A 64-bit shingle hash names one of 2**P buckets by its top bits.  A bucket keeps the
smallest of the remaining bits seen, compressed to a 16-bit register: the number of
leading zeros (6 bits, plus one, so that 0 means empty) and the MANTISSA bits that
follow the leading one.  Registers of two sets agree in a bucket with probability equal
to their Jaccard similarity plus a small chance of collision, which `estimate` takes off.

For banding, empty buckets borrow the register of a bucket drawn by a fixed sequence
("optimal densification"), so that short texts fill every band too.
"""

from __future__ import annotations

import numpy as np

from textward.llm import words

P = 7
BUCKETS = 1 << P
MANTISSA = 10
BAND = 5
BANDS = BUCKETS // BAND
_REST = 64 - P
_EMPTY = np.uint64((1 << 64) - 1)
_ATTEMPTS = 48


def _donors() -> np.ndarray:
    x = np.arange(_ATTEMPTS * BUCKETS, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F)
    return (words.mix(x) >> np.uint64(64 - P)).astype(np.int64).reshape(_ATTEMPTS, BUCKETS)


DONORS = _donors()


def registers(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """uint16[n, BUCKETS] for n sets; rows holds each set's offset in hashes."""
    n = len(rows) - 1
    least = np.full(n * BUCKETS, _EMPTY)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(rows))
    slot = row * BUCKETS + (hashes >> np.uint64(_REST)).astype(np.int64)
    # the top 53 of the remaining bits: exact as float64
    value = (hashes << np.uint64(P)) >> np.uint64(11)
    np.minimum.at(least, slot, value)
    return compress(least).reshape(n, BUCKETS)


def compress(least: np.ndarray) -> np.ndarray:
    """Register of each least 53-bit value."""
    full = least != _EMPTY
    v = np.where(full, least, np.uint64(0))
    exponent = np.frexp(v.astype(np.float64))[1].astype(np.int64)  # 0 for v = 0
    zeros = 53 - exponent
    tail = (v << (zeros + 11).astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = ((zeros + 1) << MANTISSA) | tail.astype(np.int64)
    return np.where(full, out, 0).astype(np.uint16)


def densify(regs: np.ndarray) -> np.ndarray:
    """Registers with the empty ones borrowed; a set without shingles stays empty."""
    out = regs.copy()
    todo = np.flatnonzero((regs == 0).any(axis=1) & (regs != 0).any(axis=1))
    for attempt in DONORS:
        if not len(todo):
            return out
        part = out[todo]
        gap = part == 0
        out[todo] = np.where(gap, regs[todo][:, attempt], part)
        todo = todo[(out[todo] == 0).any(axis=1)]
    for i in todo:
        full = np.flatnonzero(regs[i])
        gap = np.flatnonzero(out[i] == 0)
        out[i, gap] = regs[i, full[np.searchsorted(full, gap) % len(full)]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """uint64[n, BANDS]: a key for each run of BAND densified registers, with the band's number."""
    d = densify(regs)[:, : BANDS * BAND].reshape(len(regs), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), d.shape[:2]).copy()
    for j in range(BAND):
        key = words.mix(key * np.uint64(0xD6E8FEB86659FD93) + d[:, :, j])
    return key


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected number of registers that agree by chance, for sets of n and m shingles."""
    big, small = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    ratio = big / small
    return 0.169919487159739 * 2.0 ** (P - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets from their registers, corrected for collisions."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    return np.clip((same - collisions(n, m)) / np.maximum(used, 1), 0.0, 1.0)
