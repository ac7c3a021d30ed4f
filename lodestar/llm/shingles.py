"""Words and word shingles as 64-bit hashes, computed on Arrow buffers with numpy.

Words are `[^\\x20\\x09-\\x0D]+` over UTF-8 with A-Z lower-cased. A document's shingles are its runs
of `width` words; with fewer words the whole sequence is one; without words there are none."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RNG.integers(0, 2**64, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = int(_RNG.integers(0, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_JOIN = np.uint64(int(_RNG.integers(0, 2**62)) * 2 + 1)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes whose words are hashed at once.
STRETCH = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, per document, offsets into these. offsets[0] is 0."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = bounds(_IS_WORD[raw], offsets)
    return _word_hashes(raw, start, end), np.searchsorted(start, offsets)


def bounds(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes; none goes from one document into the next."""
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[edges] = solid[edges]
    closes[edges[1:] - 1] = solid[edges[1:] - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """Hash of each word raw[start:end], summed STRETCH bytes at a time, however long a text or word is."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + STRETCH, "right")))
        low, high = int(start[at]), int(end[upto - 1])
        if high - low <= STRETCH:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(letters[raw[low:high]] * _powers(_BASE, high - low), out=sums[1:])
            first = start[at:upto] - low
            out[at:upto] = (sums[end[at:upto] - low] - sums[first]) * _powers(_INVERSE, high - low)[first]
        else:  # a word longer than a stretch is alone
            value = 0
            for x in range(low, high, STRETCH):
                own = letters[raw[x : min(x + STRETCH, high)]]
                value += int((own * _powers(_BASE, len(own))).sum(dtype=np.uint64)) * pow(_BASE, x - low, 2**64)
            out[at] = value % 2**64
        at = upto
    return mixed(out)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle in reading order, repeats included, and offsets per document."""
    word, at = words(raw, offsets)
    n = len(word)
    if n == 0:
        return word, at
    joined = word.copy()
    for j in range(1, width):
        joined *= _JOIN
        joined[: max(n - j, 0)] += word[j:]
    valid = np.ones(n, bool)
    for j in range(1, width):
        last = at[1:] - j
        valid[last[last >= at[:-1]]] = False
    for d in np.flatnonzero((np.diff(at) < width) & (np.diff(at) > 0)):
        value = len_ = int(at[d + 1] - at[d])
        for w in word[at[d] : at[d + 1]].tolist():
            value = (value * int(_JOIN) + w) % 2**64
        joined[at[d]], valid[at[d]] = np.uint64((value ^ len_ << 56) % 2**64), True
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(valid, out=upto[1:])
    return mixed(joined[valid]), upto[at]


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of permutations of 32-bit numbers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count).astype(np.uint32)
