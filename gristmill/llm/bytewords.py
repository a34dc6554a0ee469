"""Words of many texts at once, cut on their UTF-8 bytes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


def table(ascii_chars: str) -> np.ndarray:
    """By byte: what a byte of a word becomes (A-Z lowered, bytes beyond ASCII as they are), 0 for a byte between words."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = 0
    for c in ascii_chars:
        out[ord(c)] = ord(c.lower())
    return out


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and end of neighbouring rows whose texts have at most so many bytes together."""
    sizes, first, size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)).tolist(), 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def cut(texts: pa.Array, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of ``texts`` (strings without nulls), one after the other, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    bytes_ = kept[np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0])]
    ends = (offsets - offsets[0]).astype(np.int64)
    inside = bytes_ != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]  # a text's first byte starts a word, whatever the text before ends with
    starts[firsts] = inside[firsts]
    at = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(at, ends))
    chars = bytes_[inside]
    before = np.cumsum(inside, dtype=np.int64)[at] - 1 if len(at) else np.zeros(0, np.int64)
    bounds = np.append(before, len(chars)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(chars)), counts
