"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
_RNG = np.random.default_rng(20240501)
LETTERS = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
LETTERS[65:91] = LETTERS[97:123]  # A-Z as a-z
SPREAD = np.array([2 * int(x) + 1 for x in _RNG.integers(1, 2**62, 8)], np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = BASE
        out = np.cumprod(out, dtype=np.uint64)
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and the offset at which each begins, with the end of the last."""
    t = texts.cast(pa.large_string())
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if t.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and the number of the first word of each text, with the end."""
    data, offsets = _bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~BLANK[data]
    edge = np.ones(len(data), bool)
    edge[1:] = ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = True
    starts = np.flatnonzero(word & edge)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    places = np.flatnonzero(word)
    first = np.searchsorted(places, starts)
    lengths = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    hashed = LETTERS[data[places]] * _powers(int(lengths.max()))[within]
    sums = np.add.reduceat(hashed, first)
    return mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text: of five words, or of the whole sequence where there are fewer; none without words."""
    words, first = word_hashes(texts)
    if len(words) >= WORDS:
        rolled = words[: len(words) - WORDS + 1] * SPREAD[0]
        for k in range(1, WORDS):
            rolled = rolled + words[k : len(words) - WORDS + 1 + k] * SPREAD[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif n:
            short = words[a:b] * SPREAD[WORDS : WORDS + 1]
            total = np.array([n], np.uint64)
            for k in range(n):
                total = mix(total * BASE + short[k : k + 1])
            out.append(total)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_hash(values: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    total = np.array([np.add.reduce(mix(values + SPREAD[6]))], np.uint64)
    other = np.array([np.bitwise_xor.reduce(mix(values ^ SPREAD[7])), len(values)], np.uint64)
    return int(mix(total * BASE + mix(other[:1]) + other[1:]).view(np.int64)[0])
