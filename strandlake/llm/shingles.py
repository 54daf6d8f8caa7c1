"""Word shingles as sets of 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(256, _BASE))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for each text the index of its first word (with one end more)."""
    global _powers
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    at = np.cumsum([1, *(len(r) + 1 for r in raw)])
    word = ~_GAP[data]
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    bounds = np.searchsorted(first, at)
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    span = np.diff(first, append=len(data))
    if span.max() > len(_powers):
        _powers = np.cumprod(np.full(int(span.max()) * 2, _BASE))
    place = np.arange(first[0], len(data)) - np.repeat(first, span)
    values = _BYTE[data[first[0] :]] * _powers[place]
    return mix(np.add.reduceat(values, first - first[0])), bounds


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its shingles of so many words; of all its words if it has fewer."""
    h, bounds = word_hashes(texts)
    weights = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += mix(h[i : i + n] + weights[i])  # mixed with its place, so order counts
        total *= weights[i]
    total = mix(total).view(np.int64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(total[a : b - words + 1]))
        elif b > a:
            short = hashlib.blake2b(h[a:b].tobytes(), digest_size=8, salt=b"short").digest()
            out.append(np.frombuffer(short, np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
