"""Words of many texts at once: boundaries and 64-bit hashes by numpy, without a Python step for each word."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: One odd random number for each byte value; A-Z share the numbers of a-z.
BYTE_KEYS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
BYTE_KEYS[65:91] = BYTE_KEYS[97:123]
SHORT = U64(int(_RNG.integers(1, 1 << 63, dtype=np.uint64)) | 1)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)  # of a word within its shingle

#: Bytes that end a word: blank and \t \n \v \f \r.
SPACES = np.ones(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and every byte of a code point above 127.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POSITIONS = mix(np.arange(1, 4097, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def position_keys(n: int) -> np.ndarray:
    if n <= len(_POSITIONS):
        return _POSITIONS
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def word_bounds(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in ``buf``; no word crosses an offset."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = is_word[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | cut[1:-1]
    end = m.copy()
    end[:-1] &= ~m[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, blind to the case of A-Z: sum of key[byte] * key[position], mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(first[-1] + lens[-1])
    pos = np.arange(total) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    h = np.add.reduceat(BYTE_KEYS[buf[at]] * position_keys(int(lens.max()))[pos], first)
    return mix(h + lens.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, words: int = 3) -> np.ndarray:
    """The hashes of all shingles of ``words`` words of one document, in order; of the whole sequence if it has fewer."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < words:
        return mix((hashes * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + SHORT * np.full(1, n, np.uint64))
    total = hashes[: n - words + 1] * _PLACES[0]
    for k in range(1, words):
        total += hashes[k : n - words + 1 + k] * _PLACES[k]
    return mix(total)
