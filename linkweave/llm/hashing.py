"""Word and shingle hashes of UTF-8 buffers in numpy.

A word's hash is a polynomial over table-mapped bytes modulo 2**64, read off prefix sums, so a
buffer of many documents costs a few passes and no Python object per word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
#: 64-bit values that stand for the byte values, and the base of the polynomial with its inverse.
_VALUE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_SEGMENT = 1_000_000
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, kind: str) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def words(buffer: np.ndarray, offsets: np.ndarray, fold: bool = True, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a buffer of documents; a document's bound ends a word.

    Words are maximal runs of bytes outside ``white``. Long buffers are taken in segments cut at
    white space, so memory besides the result does not follow a document's length.
    """
    n = len(buffer)
    bound = np.zeros(n + 1, dtype=bool)
    bound[offsets] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < n:
        to = min(n, at + _SEGMENT)
        if to < n:
            gaps = np.flatnonzero(white[buffer[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < n and not white[buffer[to]]:
                    to += 1
        part = FOLD[buffer[at:to]] if fold else buffer[at:to]
        blank = white[part]
        cut = bound[at : to + 1]
        before = np.empty(len(part), dtype=bool)
        before[0] = True
        before[1:] = blank[:-1]
        first = np.flatnonzero(~blank & (before | cut[:-1]))
        after = np.empty(len(part), dtype=bool)
        after[-1] = True
        after[:-1] = blank[1:]
        last = np.flatnonzero(~blank & (after | cut[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_VALUE[part] * _power(_BASE, len(part), "up"), out=sums[1:])
            h = mix((sums[last] - sums[first]) * _power(_INVERSE, len(part), "down")[first])
        found.append((h, first + at, last + at))
        at = to
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), empty, empty
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes; none if it is shorter."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _U(0xD6E8FEB86659FD93) + h[i : i + m] + _U(i + 1))
    return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; a shorter sequence is one shingle, an empty one none."""
    if not len(h):
        return h
    return np.unique(windows(h, min(k, len(h))))
