"""Word and shingle hashes straight from Arrow's string buffers, in numpy.

Words are maximal runs of bytes other than the six ASCII white-space ones, with A-Z lowered.  A word's hash is a
polynomial over its bytes modulo 2**64; a shingle's mixes its words' hashes in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix; a permutation of the 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_powers.get("up", ()))
    if have < n:
        n = max(n, _STEP)
        for name, p in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, p, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null is as long as an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and per text the index of its first word (one more entry at the end)."""
    low, out = _LOWER[data], ~_SPACE[data]
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = out.copy(), out.copy()
    first[1:] &= ~out[:-1] | cut[1:-1]
    last[:-1] &= ~out[1:] | cut[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(s), U)
    i = 0
    while i < len(s):  # in strips of some 256 KB, each from the start of a word
        j = max(i + 1, int(np.searchsorted(e, s[i] + _STEP, "right")))
        up, down = _power(int(e[j - 1] - s[i]) + 1)
        strip = low[s[i] : e[j - 1]].astype(U)
        total = np.zeros(len(strip) + 1, U)
        np.cumsum((strip + U(1)) * up[: len(strip)], out=total[1:])
        a, b = s[i:j] - s[i], e[i:j] - s[i]
        hashes[i:j] = (total[b] - total[a]) * down[a]
        i = j
    return mixed(hashes), np.searchsorted(s, offsets)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of ``n`` words; fewer words are one shingle, none are no shingle."""
    h, at = word_hashes(*buffers(texts))
    factors = mixed(np.arange(1, n + 1, dtype=U) * U(_BASE)) | U(1)
    grams = np.zeros(max(0, len(h) - n + 1), U)
    for k in range(n):
        grams += h[k : k + len(grams)] * factors[k]
    grams = mixed(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = h[a:b] * factors[: b - a]
            out.append(mixed(short.sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
