"""Word shingles as 64-bit hashes, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Words of a shingle, and odd multipliers of its words.
WORDS = 5
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: Bytes of text that are worked on at once.
SLICE_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters, one text at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and each text's bounds in them.

    Words are split at ASCII white space. A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter((len(s) for s in split), dtype=np.int64, count=len(split))
    bounds = np.zeros(len(split) + 1, dtype=np.int64)
    if not counts.sum():
        return np.empty(0, dtype=np.uint64), bounds
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for s in split for w in s]
    hashed = pd.util.hash_array(flat, categorize=False)
    starts = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([hashed, np.zeros(words, dtype=np.uint64)])
    value = np.zeros(len(hashed), dtype=np.uint64)
    left = np.repeat(starts[1:], counts) - np.arange(len(hashed))
    for k in range(words):
        value += np.where(left > k, padded[k : k + len(hashed)] * MULTIPLIERS[k], np.uint64(0))
    value = mixed(value)
    whole = (left >= words) | (np.arange(len(hashed)) == np.repeat(starts[:-1], counts))
    parts = []
    for i in range(len(split)):
        a, b = starts[i], starts[i + 1]
        own = np.unique(value[a:b][whole[a:b]]) if b > a else value[:0]
        parts.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return np.concatenate(parts), bounds
