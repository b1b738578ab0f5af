"""External induced sorting of suffixes, with common-prefix values, in numpy.

The sorter follows the induction of suffix order from the leftmost-S (LMS) suffixes. Its queues are keyed by the first
character of a suffix and first-in first-out inside a key, which is the order in which an induction meets them: pops are
monotone in the key, so a bucket per key with appended runs is a priority queue. Runs go to a scratch file as soon as the
queue holds more than its memory; a bucket is read back run by run when its turn comes, so a shard may be far larger than
memory. LMS substrings are sorted by a first induction and named; the string of names is sorted by recursive renaming of
triples of names until all are distinct, and a second induction gives all suffixes.

Common prefixes come from the sorted order by way of text order: a value is computed by comparison only where the
characters before a suffix and before its predecessor differ (or at the start of a piece); everywhere else it is one less
than its left neighbour's. Separators end a common prefix.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that a queue holds in memory before it writes runs to its scratch file.
QUEUE_BYTES = 64 << 20
#: Positions of one bucket that are worked on at once.
JOINED = 4 << 20
#: Texts above this many bytes keep their order arrays in scratch files.
MEMORY_TEXT = 24 << 20


class BucketQueue:
    """Monotone priority queue of suffix positions by character, spilling runs to disk."""

    def __init__(self, folder: str, memory: int = QUEUE_BYTES):
        self.runs: list[list] = [[] for _ in range(256)]
        self.held, self.memory = 0, memory
        self.file = tempfile.TemporaryFile(dir=folder)

    def push(self, char: int, run: np.ndarray) -> None:
        if not len(run):
            return
        if self.held + run.nbytes > self.memory:
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(run.tobytes())
            self.runs[char].append((at, len(run), run.dtype))
        else:
            self.runs[char].append(run)
            self.held += run.nbytes

    def spread(self, chars: np.ndarray, positions: np.ndarray) -> None:
        """Push every position under its character, in order."""
        if len(chars) < 2:
            for c in chars:
                self.push(int(c), positions)
            return
        order = np.argsort(chars, kind="stable")
        moved, count = positions[order], np.bincount(chars, minlength=256)
        ends = np.cumsum(count)
        for c in np.flatnonzero(count):
            self.push(int(c), moved[ends[c] - count[c] : ends[c]])

    def pop(self, char: int) -> Iterator[np.ndarray]:
        """Runs of a character in the order of arrival, joined, those that arrive meanwhile included."""
        i = 0
        while i < len(self.runs[char]):
            joined, size = [], 0
            while i < len(self.runs[char]) and size < JOINED:
                run = self.runs[char][i]
                if isinstance(run, tuple):
                    self.file.seek(run[0])
                    run = np.frombuffer(self.file.read(run[1] * run[2].itemsize), dtype=run[2])
                else:
                    self.held -= run.nbytes
                self.runs[char][i] = None
                joined.append(run)
                size += len(run)
                i += 1
            yield joined[0] if len(joined) == 1 else np.concatenate(joined)
        self.runs[char] = []

    def close(self) -> None:
        self.file.close()


def _array(n: int, dtype, folder: str, big: bool) -> np.ndarray:
    if not big or not n:
        return np.zeros(n, dtype=dtype)
    return np.memmap(tempfile.TemporaryFile(dir=folder), dtype=dtype, mode="w+", shape=(n,))


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S). The last position, a separator, is S."""
    n = len(text)
    step = np.empty(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = 1
    decided = np.where(step != 0, np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), n - 1)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, folder: str, big: bool, lms_only: np.ndarray | None = None) -> np.ndarray:
    """All positions in induced order, from LMS positions ``seeds`` in order; with ``lms_only`` only positions it marks."""
    index = np.int64 if len(text) >= 1 << 31 else np.int32
    by_seed = np.searchsorted(text[seeds].astype(np.int64), np.arange(257)) if len(seeds) else np.zeros(257, dtype=np.int64)
    lows, highs = BucketQueue(folder), BucketQueue(folder)
    sorted_low: list[list[np.ndarray]] = [[] for _ in range(256)]
    spill = BucketQueue(folder) if big else None

    def before(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = run[run > 0] - 1
        return text[at], at

    for c in range(256):  # L suffixes, ascending
        for run in lows.pop(c):
            if spill is None:
                sorted_low[c].append(run)
            else:
                spill.push(c, run)
            chars, at = before(run)
            keep = chars >= c
            lows.spread(chars[keep], at[keep])
        chars, at = before(seeds[by_seed[c] : by_seed[c + 1]])
        lows.spread(chars, at)
    total = int(lms_only.sum()) if lms_only is not None else len(text)
    out, end = _array(total, index, folder, big), total
    for c in range(255, -1, -1):  # S suffixes, descending, then the L suffixes of the same character
        for run in highs.pop(c):
            chosen = run if lms_only is None else run[lms_only[run]]
            out[end - len(chosen) : end] = chosen[::-1]
            end -= len(chosen)
            chars, at = before(run)
            keep = chars <= c
            highs.spread(chars[keep], at[keep])
        runs = sorted_low[c] if spill is None else list(spill.pop(c))
        for run in reversed(runs):
            back = run[::-1]
            if lms_only is None:
                out[end - len(back) : end] = run
                end -= len(back)
            chars, at = before(back)
            keep = chars < c
            highs.spread(chars[keep], at[keep])
        sorted_low[c] = []
        if c == 0 and len(text):  # the last separator has no successor that induces it
            last = np.array([len(text) - 1], dtype=index)
            chosen = last if lms_only is None else last[lms_only[last]]
            out[end - len(chosen) : end] = chosen
            end -= len(chosen)
    lows.close()
    highs.close()
    if spill is not None:
        spill.close()
    return out


def _names(text: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names from 1 of LMS substrings in sorted order; equal substrings share a name."""
    a, b = order[:-1], order[1:]
    differs = length[a] != length[b]
    live, depth = np.flatnonzero(~differs), 0
    while len(live):
        other = text[a[live] + depth] != text[b[live] + depth]
        differs[live[other]] = True
        live = live[~other]
        depth += 1
        live = live[length[a[live]] >= depth]
    return np.concatenate([[1], 1 + np.cumsum(differs)])


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of the string of names, by renaming triples of names until all differ."""
    m, reach, rank = len(names), 1, names.astype(np.uint64)
    while True:
        bits = max(1, int(rank.max()).bit_length())
        width = 3 if 3 * bits <= 64 else 2
        key = rank.copy()
        for k in range(1, width):
            key <<= np.uint64(bits)
            if k * reach < m:
                key[: m - k * reach] |= rank[k * reach :]
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(m, dtype=np.uint64)
        fresh = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
        new[order] = fresh
        rank, reach = new, reach * width
        if int(fresh[-1]) == m or reach >= m:
            return order


def suffix_order(text: np.ndarray, folder: str | None = None) -> np.ndarray:
    """Suffix array of ``text`` (uint8, 0 only as separator and as the last character)."""
    folder = folder or tempfile.gettempdir()
    big = len(text) > MEMORY_TEXT
    small = types(text)
    lms = np.zeros(len(text), dtype=bool)
    lms[1:] = small[1:] & ~small[:-1]
    at = np.flatnonzero(lms).astype(np.int64 if len(text) >= 1 << 31 else np.int32)
    if len(at) > 1:
        guess = at[np.argsort(text[at], kind="stable")]
        order = _induce(text, small, guess, folder, big, lms)
        length = np.zeros(len(text), dtype=np.int32)
        length[at[:-1]] = np.diff(at)
        names = _names(text, order, length)
        place = np.empty(len(text), dtype=np.int64)
        place[order] = names
        reduced = place[at]
        del place, length, order
        at = at[_sort_names(reduced)] if int(names[-1]) < len(at) else at[np.argsort(reduced)]
    return _induce(text, small, at, folder, big)


def prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every position, the common prefix with its predecessor in ``order``, up to a separator."""
    n = len(text)
    left = np.empty(n, dtype=order.dtype)
    left[order[1:]] = order[:-1]
    left[order[0]] = n - 1
    here = np.arange(n, dtype=order.dtype)
    fresh = np.ones(n, dtype=bool)
    some = (here > 0) & (left > 0)
    same = (text[np.maximum(here, 1) - 1] == text[np.maximum(left, 1) - 1]) & some & (text[np.maximum(here, 1) - 1] != 0)
    fresh[same] = False
    start = np.flatnonzero(fresh)
    a, b = start.astype(np.int64), left[start].astype(np.int64)
    value = np.zeros(len(start), dtype=np.int32)
    words = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(8, dtype=np.uint8)]).view(np.uint8), shape=(n + 1, 8), strides=(1, 1))
    live = np.flatnonzero(a != b)
    while len(live):
        p, q = a[live] + value[live], b[live] + value[live]
        ok = (p < n) & (q < n)
        live, p, q = live[ok], p[ok], q[ok]
        x, y = words[p], words[q]
        stop = (x != y) | (x == 0)
        gained = np.where(stop.any(axis=1), stop.argmax(axis=1), 8)
        value[live] += gained.astype(np.int32)
        live = live[gained == 8]
    source = np.cumsum(fresh) - 1
    return value[source] - (np.arange(n) - start[source]).astype(np.int32)


def repeated(text: np.ndarray, width: int, folder: str | None = None) -> np.ndarray:
    """True where the ``width`` characters from a position also start elsewhere, without crossing a separator."""
    order = suffix_order(text, folder)
    common = prefixes(text, order) >= width
    out = np.zeros(len(text), dtype=bool)
    hit = np.flatnonzero(common[order])
    out[order[hit]] = True
    out[order[hit[hit > 0] - 1]] = True
    return out
