"""64-bit hashes of words and of runs of words, computed for a whole text at once.

A run's hash is a polynomial in a fixed odd base modulo 2**64, taken from differences of prefix sums and then mixed.
Equal runs have equal hashes; two different ones collide with a probability of about 2**-64 in texts that weren't made for it.
A polynomial modulo 2**64 has no bound against an adversary: words of a thousand letters and more can be made that collide.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: A random value for each byte; white space of the contracts is what bytes.split() cuts at.
BYTES = np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX
    return h ^ (h >> U(29))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word of data, in order."""
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    blank = np.ones(len(b) + 2, np.int8)
    blank[1:-1] = SPACES[b]
    edges = np.flatnonzero(np.diff(blank))
    return _runs(BYTES[b], edges[::2], edges[1::2])


def run_hashes(words: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The hash of n consecutive words from each of starts, by default from every word that has so many."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    if starts is None:
        starts = np.arange(len(words) - n + 1)
    return _runs(words, starts, starts + n)


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """Distinct hashes of runs of n words, sorted; of all words as one run, where there are fewer."""
    words = word_hashes(data)
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else words
