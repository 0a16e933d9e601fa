"""Vectorised byte, word and window primitives over concatenated UTF-8 documents.

A batch is one ``uint8`` buffer in which every document is followed by one ``\\n``;
white space is the six bytes 0x20 and 0x09 to 0x0D, so a word never crosses a document.
All hashes are 64-bit polynomial hashes with a final avalanche.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WS = np.zeros(256, dtype=bool)
WS[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE64 = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_tables: dict[int, np.ndarray] = {}
#: Values of sliding() that are handled at once.
AT_ONCE = 1 << 15
#: Powers of a base that are kept, 8 MB; a longer buffer has its own while it is hashed.
KEPT_POWERS = 1 << 20


@functools.cache
def _malloc_trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return int


def give_back() -> None:
    """Return free memory of Arrow and of the C library to the system, which by themselves hold what a task took at most."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, after which its worker, kept for other tasks, gives memory back."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; grown by doubling, and kept up to KEPT_POWERS."""
    t = _tables.get(base)
    if t is None or len(t) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        t = np.full(size if size <= KEPT_POWERS else n, base, dtype=U64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        if size <= KEPT_POWERS:
            _tables[base] = t
    return t[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; the buffer ends in white space (or is empty)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ws = WS[buf]
    edge = np.empty(len(buf), dtype=bool)
    edge[0] = not ws[0]
    np.not_equal(ws[1:], ws[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word."""
    if not len(starts):
        return np.zeros(0, U64)
    c = np.empty(len(buf) + 1, dtype=U64)
    c[0] = 0
    np.multiply(BYTE64[buf], powers(_P, len(buf)), out=c[1:])
    np.cumsum(c, out=c)
    return mix64((c[ends] - c[starts]) * powers(_PINV, len(buf))[starts])


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each start (``len(h) - width + 1`` of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = np.empty(len(h) + 1, dtype=U64)
    c[0] = 0
    np.multiply(h, powers(_P, len(h)), out=c[1:])
    np.cumsum(c, out=c)
    return mix64((c[width:] - c[:n]) * powers(_PINV, n))


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, by spans that double, in pieces that fit a cache."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    out = np.empty(n, x.dtype)
    for a in range(0, n, AT_ONCE):
        b = min(n, a + AT_ONCE)
        y, span = x[a : b + width - 1], 1
        while 2 * span <= width:
            y = op(y[:-span], y[span:])
            span *= 2
        op(y[: b - a], y[width - span : width - span + b - a], out=out[a:b])
    return out


def covered(flags: np.ndarray, width: int, size: int) -> np.ndarray:
    """Positions of ``size`` that a flagged window start covers; starts beyond are absent."""
    at = np.flatnonzero(flags)
    out = np.zeros(size, dtype=bool)
    if len(at):
        gap = np.flatnonzero(at[1:] > at[:-1] + width)
        for a, b in zip(at[np.concatenate([[0], gap + 1])].tolist(), at[np.concatenate([gap, [len(at) - 1]])].tolist(), strict=True):
            out[a : b + width] = True
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    e = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return e[0::2], e[1::2]


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of ``x`` in a sorted array."""
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    i = np.searchsorted(table, x)
    i[i == len(table)] = 0
    return table[i] == x
