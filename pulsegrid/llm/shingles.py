"""Hashed word shingles of texts, in numpy over whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WORDS = 5
#: Bytes hashed at once; a longer word is hashed alone.
_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.random.default_rng(7).integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _CHUNK), _powers(_BACK, _CHUNK)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each data[start:end], from prefix sums modulo 2 ** 64."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        first, size = int(starts[i]), int(ends[j - 1] - starts[i])
        up, down = (_UP, _DOWN) if size <= _CHUNK else (_powers(_BASE, size), _powers(_BACK, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[data[first : first + size]] * up[:size], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the 5-word shingles of each text.

    A-Z are lower-cased, words are runs without ASCII white space.  A text with fewer words is
    one shingle, a null text or one without words has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return [np.zeros(0, np.uint64)] * len(texts)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    word = ~_SPACE[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    begins[inner] |= word[inner]
    stops[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    h = _word_hashes(data, starts, ends)
    n = len(h)
    full = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        full += h[k : k + len(full)] * _STEPS[k]
    full = mix64(full)
    at = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
