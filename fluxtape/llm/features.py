"""Hashed word features of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are turned to arrays at a time.
CHUNK = 1 << 21
#: Prefix lengths, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def slices(batches, rows: int = 500):
    """Parts of record batches, so that few texts at a time are Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range by itself."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield lo, i
            lo, held = i, 0
        held += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first 8 bytes, last 8 bytes, length)`` of every word, A-Z lower-cased.

    Words are runs of bytes that are not ASCII white space; bytes past a short
    word's end are zero.
    """
    joined = b" " * 8 + b" ".join(texts).lower() + b" " * 8
    data = np.frombuffer(joined, np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    size = end - start
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    head = eight[start].view(np.uint64).ravel() & _MASKS[np.minimum(size, 8)]
    tail = eight[end - 8].view(np.uint64).ravel()
    tail = np.where(size > 8, tail, np.uint64(0))
    begins = 8 + np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    row = np.searchsorted(begins, start, side="right") - 1
    return row, head, tail, size


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, 32-bit feature)``: each word and its prefixes, repeats included.

    A word counts by its first and last eight bytes and its length.
    """
    row, head, tail, size = words(texts)
    rows = [row]
    made = [_mix(head ^ _mix(tail + size.astype(np.uint64)))]
    for k in PREFIXES:
        use = np.flatnonzero(size >= k)
        rows.append(row[use])
        made.append(_mix((head[use] & _MASKS[k]) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(made) >> np.uint64(32)).astype(np.uint32)


def distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row.astype(np.uint64) << np.uint64(32)) | feature)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
