"""Word shingles as 64-bit hashes, computed over whole batches of texts with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RANDOM = np.random.Generator(np.random.Philox(20240117))
_BYTES = _RANDOM.integers(0, 1 << 64, 256 * 256, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the number of words by text."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    at = np.flatnonzero(inside)
    sizes = ends - starts
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = _BYTES[((place & 255) << 8) | data[at]]
    if sizes.max() > 256:
        values *= (place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64)), counts


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """By text, its distinct shingles in rising order.

    A text of fewer words is one shingle, the whole sequence; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    size = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(size, dtype=np.uint64)
    for k in range(words):
        rolled += hashes[k : k + size] * _PLACES[k]
    rolled = mix(rolled)
    sets, start = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(rolled[start : start + n - words + 1]))
        elif n:
            whole = np.sum(hashes[start : start + n] * _PLACES[:n], dtype=np.uint64, keepdims=True)
            sets.append(mix(whole + np.uint64(n)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        start += n
    return sets
