"""Words of UTF-8 texts and 64-bit hashes of runs of words, by whole-array arithmetic."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _table(wanted) -> np.ndarray:
    return np.array([wanted(b) for b in range(256)], bool)


#: Word bytes of near-duplicate detection: all but white space.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes of decontamination, once A-Z are lower case: digits, letters and all beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTERS = mixed(np.arange(1, 257, dtype=U))
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64; kept while they suffice."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, U(base))
            steps[0] = U(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def bounds(text: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where each word starts and ends."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word_bytes[raw]
    step = np.diff(inside)
    return raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial in a random value of each byte, modulo 2^64, then mixed."""
    if not len(start):
        return np.empty(0, U)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(LETTERS[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(U))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * U(BASE) + words[k : k + m]
    return mixed(h + U(n))
