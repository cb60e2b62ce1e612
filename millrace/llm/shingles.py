"""Word shingles as 64-bit hashes, and Fast Similarity Sketches of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
CACHE_WORDS = 100_000
COORDS = 128

_M = (1 << 64) - 1
#: Odd multipliers for the positions of a shingle.
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BIN = np.uint64(57)
_ROUND = np.uint64(49)
_LOW57 = np.uint64((1 << 57) - 1)
_LOW49 = np.uint64((1 << 49) - 1)
_EDGES = np.arange(COORDS, dtype=np.uint64) << _BIN


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: One odd constant per round; bounded, as there are two rounds per coordinate at most.
_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words make one shingle."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    if n < 1:
        h = np.uint64(len(w))
        for k in range(len(w)):
            h = np.uint64((int(h) * 0x9E3779B97F4A7C15 + int(w[k])) & _M)
        return mix(np.array([h]))
    h = w[:n] * _POWERS[0]
    for k in range(1, WORDS):
        h = h + w[k : k + n] * _POWERS[k]
    return np.unique(mix(h))


def sketch(items: np.ndarray) -> np.ndarray:
    """The set's coordinates, each the least (round, value) that fell into its bin.

    In round i < COORDS every item is thrown into a hashed bin; in round COORDS + j
    every item goes to bin j. So every coordinate fills, and large sets need one
    round. Rounds run in batches of about equal work and stop once all bins are full.
    """
    out = np.zeros(COORDS, np.uint64)
    empty = np.ones(COORDS, bool)
    at, n = 0, len(items)
    while at < 2 * COORDS and empty.any():
        upto = min(2 * COORDS, at + max(1, min(COORDS, 2048 // n)))
        rounds = np.arange(at, upto, dtype=np.uint64)[:, None]
        h = mix(items[None, :] ^ _SEEDS[at:upto, None])
        bins = h >> _BIN
        late = rounds >= np.uint64(COORDS)
        if late.any():
            bins = np.where(late, rounds - np.uint64(COORDS), bins)
        keys = np.sort(((bins << _BIN) | (rounds << _ROUND) | (h & _LOW49)).ravel())
        first = np.searchsorted(keys, _EDGES)
        hit = first < len(keys)
        hit[hit] = (keys[first[hit]] >> _BIN) == np.flatnonzero(hit).astype(np.uint64)
        new = hit & empty
        out[new] = keys[first[new]] & _LOW57
        empty &= ~hit
        at = upto
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band, the band's number mixed in."""
    part = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return key.view(np.int64)


def class_key(items: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(items.tobytes())
