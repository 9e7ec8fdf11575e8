"""Word shingles of texts as 64-bit hashes, with numpy over batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 18  # bytes hashed at a time
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE + 1), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ np.uint64(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a byte array."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return starts, mix(h ^ (ends - starts).astype(np.uint64) << np.uint64(56))


def _of_words(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles of one document's word hashes, sorted; all words as one if there are fewer than k."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x100000001B3) + words[i:i + n])
    return np.unique(h)


def sets(texts: list, k: int) -> Iterator[np.ndarray]:
    """The set of each text (bytes or None), A-Z taken as a-z."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < SLICE):
            size += len(texts[end] or b"") + 1
            end += 1
        part = [(t or b"").lower() for t in texts[at:end]]  # bytes.lower() touches A-Z only
        bounds = np.cumsum([0, *(len(t) + 1 for t in part)])
        starts, words = _word_hashes(np.frombuffer(b" ".join([*part, b""]), np.uint8))
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _of_words(words[a:b], k)
        at = end
