"""Cover densities in tiles: questions of a block meet the postings of columns of chunks, each question keeps its best.

A place is one number, ``chunk << 32 | position``, so the places of a word in all chunks of a column are one sorted array.
Postings come as rows of one word each, or as rows of one chunk with all its words as 32-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a cover without gap counts.
WEIGHT = 0.1
#: Scores are whole numbers of this part; a cover without gap, as such a number.
SCALE = 1_000_000
WHOLE = round(WEIGHT * SCALE)
#: No chunks, no scores.
NONE = np.zeros(0, np.int64)
#: Postings of a column, at most about, and of a task, at least about; questions of a block.
COLUMN_POSTINGS, LEAST_POSTINGS, BLOCK_QUESTIONS = 3 << 21, 1 << 19, 1 << 17
#: Chunks that a question ranks before bounds decide about the others; questions read at a time.
HEAD, READ = 64, 1024
#: Bits of a position, and what is added to it, so that no position becomes negative.
BITS, SHIFT = 32, 1 << 31


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where another value begins in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _united(parts: list[np.ndarray]) -> np.ndarray:
    """The different values of sorted arrays, sorted: runs are merged, nothing is hashed."""
    values = np.sort(np.concatenate(parts), kind="stable") if len(parts) > 1 else parts[0]
    return values[_firsts(values)]


def _within(places: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The indices of sorted ``places`` that lie in sorted ``chunks``."""
    low, high = np.searchsorted(places, chunks << BITS), np.searchsorted(places, (chunks + 1) << BITS)
    sizes = high - low
    return np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values that two sorted arrays of different values share stand in each."""
    if len(a) > len(b):
        return _common(b, a)[::-1]
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = np.flatnonzero(b[at] == a)
    return hit, at[hit]


def _first(chunks: np.ndarray, score: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` chunks of greatest score, at least ``floor``, ties by chunk."""
    least = max(floor, np.partition(score, -k)[-k]) if len(score) > k else floor
    near = np.flatnonzero(score >= least)
    order = near[np.lexsort((chunks[near], -score[near]))[:k]]
    return chunks[order], score[order]


def _whole(density: np.ndarray) -> np.ndarray:
    return np.floor(density * SCALE + (0.5 + 1e-6)).astype(np.int64)


def _pair(a: _Unit, b: _Unit, chunks: np.ndarray) -> np.ndarray:
    """Whole scores of sorted ``chunks`` that hold both of two different words.

    A cover lies between neighbouring places of different words, so each place of the rarer word is looked up once.
    """
    if not len(chunks):
        return NONE
    a, b = sorted((a, b), key=lambda u: len(u.starts))
    own = np.searchsorted(a.chunks, chunks)
    counts = a.counts[own]
    first = np.cumsum(counts) - counts
    places = a.starts[np.repeat(a.firsts[own] - first, counts) + np.arange(first[-1] + counts[-1])]
    at, chunk = np.searchsorted(b.starts, places), places >> BITS
    before, after = b.starts[at - 1], b.starts[np.minimum(at, len(b.starts) - 1)]
    left = (at > np.append(0, at[:-1])) & (before >> BITS == chunk)
    right = (at < np.append(at[1:], len(b.starts))) & (after >> BITS == chunk)
    part = left / np.where(left, places - before, 1) + right / np.where(right, after - places, 1)
    return _whole(WEIGHT * np.add.reduceat(part, first))


class _Unit:
    """A word or phrase of a question: its words with their places, and where it stands in a column."""

    def __init__(self, rows: list[tuple[int, int]], column: _Column):
        self.low, self.high = min(p for p, _ in rows), max(p for p, _ in rows)
        self.word = rows[0][1] if len(rows) == 1 else None
        self.places = sorted({p - self.low for p, _ in rows})
        spots = sorted((column.places(w) - (p - self.low) if p > self.low else column.places(w) for p, w in rows), key=len)
        self.starts = spots[0]
        for other in spots[1:]:
            at = np.searchsorted(other, self.starts)
            at[at == len(other)] = 0
            self.starts = self.starts[other[at] == self.starts] if len(other) else other
        chunk = self.starts >> BITS
        self.firsts = _firsts(chunk)
        self.chunks, self.counts = chunk[self.firsts], np.diff(np.append(self.firsts, len(chunk)))


class _Column:
    """The postings of one column, in any order; with ``sizes``, each of ``chunks`` stands for so many of them."""

    def __init__(self, words: np.ndarray, chunks: np.ndarray, positions: np.ndarray, sizes: np.ndarray | None = None):
        self.ids, local = np.unique(chunks, return_inverse=True)
        places = local.astype(np.int64) if sizes is None else np.repeat(local.astype(np.int64), sizes)
        places <<= BITS
        places += positions
        places += SHIFT
        order = np.argsort(places)
        named, numbers = (None, words) if words.dtype == np.int32 else np.unique(words, return_inverse=True)
        keys = numbers[order].astype(np.int64)
        keys <<= 32
        keys += np.arange(len(order))
        keys.sort()
        self.all, words = places[order[keys & 0xFFFFFFFF]], keys >> 32
        del places, order, keys
        first = _firsts(words)
        self.words = words[first] if named is None else named[words[first]]
        runs = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (self.all[1:] >> BITS != self.all[:-1] >> BITS))) if len(words) else first
        self.most = np.maximum.reduceat(np.diff(np.append(runs, len(words))), np.searchsorted(runs, first)) if len(words) else first
        self.single: dict[int, _Unit] = {}
        self.at = dict(zip(self.words.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(words)], strict=True), strict=True))

    def places(self, word: int) -> np.ndarray:
        return self.all[slice(*self.at.get(word, (0, 0)))]

    def unit(self, rows: list[tuple[int, int]]) -> _Unit:
        """A word alone is the same unit in every question."""
        if len(rows) > 1:
            return _Unit(rows, self)
        word = rows[0][1]
        if word not in self.single:
            self.single[word] = _Unit([(0, word)], self)
        return self.single[word]

    def reach(self, ids: np.ndarray, words: np.ndarray, marks: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Questions that a chunk here may answer with their floor or more; rows are sorted by question, then mark.

        No chunk holds a word more often than some chunk holds it, so the greatest counts of a question's words bound its densities.
        """
        named = np.flatnonzero(marks & 1 == 0)
        if not len(named) or not len(self.words):
            return ids[:0]
        own, mark, at = ids[named], marks[named], np.searchsorted(self.words, words[named])
        at[at == len(self.words)] = 0
        most = np.where(self.words[at] == words[named], self.most[at], 0)
        other = np.append(True, own[1:] != own[:-1])
        unit, alt = other | np.append(True, mark[1:] != mark[:-1]), np.flatnonzero(other | np.append(True, mark[1:] >> 32 != mark[:-1] >> 32))
        bound = np.minimum.reduceat(most, alt) * np.add.reduceat(unit.astype(np.int64), alt) * WHOLE
        first = np.flatnonzero(other[alt])
        asked = own[alt[first]]
        return asked[np.add.reduceat(bound, first) >= np.maximum(floors[asked], 1)]

    def best(self, asked: list[tuple[int, int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and whole scores, at least ``floor``, of the ``k`` chunks of greatest density, ties by id; ``asked`` are (mark, place, word)
        of a question.

        Where no unit of another alternative stands, the density of one phrase or of two words is summed at once; other chunks are ranked by
        covers, those of greatest bound first.
        """
        rows: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for mark, place, word in asked:
            rows.setdefault((mark >> 32, mark >> 1, mark & 1), []).append((place, word))
        named = sorted({alt for alt, _, excluded in rows if not excluded})
        if not any(all(w in self.at for (a, _, excluded), r in rows.items() if a == alt and not excluded for _, w in r) for alt in named):
            return self.ids[:0], np.zeros(0, np.int64)
        alts = [[self.unit(r) for (a, _, excluded), r in rows.items() if a == alt and not excluded] for alt in named]
        bound, done, rest = [], [(NONE, NONE)], [NONE]
        for alt, held in zip(named, alts, strict=True):
            chunks, least, step = held[0].chunks, held[0].counts, len(held) * WHOLE
            for u in held[1:]:
                i, j = _common(chunks, u.chunks)
                chunks, least = chunks[i], np.minimum(least[i], u.counts[j])
            bound.append((chunks, least * step))
            fit = np.ones(len(chunks), bool)
            for (a, _, excluded), r in rows.items():
                if a == alt and excluded:
                    fit[_common(chunks, self.unit(r).chunks)[0]] = False
            pair = len(held) == 2 == len({u.word for u in held} - {None})
            alone = fit & (pair or (len(held) == 1 and len(held[0].places) == 1 + held[0].high - held[0].low))
            for u in (u for other in alts if other is not held for u in other):
                alone[_common(chunks, u.chunks)[0]] = False
            rest.append(chunks[fit & ~alone])
            alone &= least * step >= floor
            done.append((chunks[alone], _pair(*held, chunks[alone]) if pair else least[alone] * WHOLE))
        chunks, score = (np.concatenate(x) for x in zip(*done, strict=True))
        chunks, score = _first(chunks, score, k, floor)
        rest = _united(rest)
        if len(rest):
            most = np.zeros(len(self.ids), np.int64)
            for held, least in bound:
                most[held] += least
            head = rest
            if len(rest) > max(HEAD, k):
                order = rest[np.lexsort((rest, -most[rest]))]
                head, rest = np.sort(order[: max(HEAD, k)]), np.sort(order[max(HEAD, k) :])
            else:
                rest = rest[:0]
            for part in (head, rest):
                part = part[most[part] >= max(floor, score[k - 1] if len(score) >= k else 0)]
                if len(part):
                    chunks, score = _first(np.concatenate([chunks, part]), np.concatenate([score, self._density(alts, part)]), k, floor)
        return self.ids[chunks], score

    def _density(self, alts: list[list[_Unit]], chunks: np.ndarray) -> np.ndarray:
        """Whole scores of sorted ``chunks`` that match.

        At each end of a unit, an alternative reaches back to the least of its units' latest starts; the best alternative's start and
        the first end that reaches it make a cover. The gap is the stretch less the places that units fill.
        """
        held = [[(u, u.starts[_within(u.starts, chunks)]) for u in alt] for alt in alts]
        ends = _united([s + (u.high - u.low) for alt in held for u, s in alt])
        reached = np.full(len(ends), -1)
        for alt in held:
            start = None
            for u, s in alt:
                at = np.searchsorted(s, ends - (u.high - u.low), side="right") - 1
                last = s[at] if len(s) else np.full(len(ends), -1)
                last = np.where((at >= 0) & (last >> BITS == ends >> BITS), last, -1)
                start = last if start is None else np.minimum(start, last)
            reached = np.maximum(reached, start)
        ends, reached = ends[reached >= 0], reached[reached >= 0]
        first = _firsts(reached)
        ends, reached = ends[first], reached[first]
        filled = _united([s + p for alt in held for u, s in alt for p in u.places])
        gap = ends - reached - (np.searchsorted(filled, ends) - np.searchsorted(filled, reached))
        total = np.bincount(np.searchsorted(chunks, reached >> BITS), WEIGHT / (1 + gap), len(chunks))
        return _whole(total)


def _numbers(packed: pa.Array) -> np.ndarray:
    """All 32-bit numbers of a binary column without nulls."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.int32, (at[-1] - at[0]) // 4, at[0])


class _Asked:
    """Questions of a task with their best ``k`` chunks so far; what does not reach the last of them is left out of later columns."""

    def __init__(self, k: int, asked: list[list[np.ndarray]]):
        own, self.words, self.places, self.marks = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.lexsort((self.places, self.marks, own))
        own, self.words, self.places, self.marks = own[order], self.words[order], self.places[order], self.marks[order]
        self.first = _firsts(own)
        self.ids, self.ends = own[self.first], np.append(self.first[1:], len(own))
        self.own = np.repeat(np.arange(len(self.ids)), self.ends - self.first)
        self.score, self.found = np.full((len(self.ids), k), -1), np.zeros((len(self.ids), k), np.int64)
        self.k = k

    def meet(self, column: _Column) -> None:
        near = column.reach(self.own, self.words, self.marks, np.maximum(self.score[:, -1], 0))
        for i in near.tolist():
            rows = slice(self.first[i], self.ends[i])
            asked = list(zip(self.marks[rows].tolist(), self.places[rows].tolist(), self.words[rows].tolist(), strict=True))
            found, score = column.best(asked, self.k, max(int(self.score[i, -1]), 0))
            if len(found):
                found, score = np.concatenate([self.found[i], found]), np.concatenate([self.score[i], score])
                order = np.lexsort((found, -score))[: self.k]
                self.found[i], self.score[i] = found[order], score[order]

    def drain(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), READ):
            i, j = np.nonzero(self.score[at : at + READ] >= 0)
            columns = self.ids[at + i], self.found[at + i, j], self.score[at + i, j] / SCALE
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["question_id", "chunk_id", "score"])


def _met(k: int):
    """Rows of a task: those of questions have a mark. Rows of whole chunks come behind them, the longest first, and are taken in columns;
    rows of single words come in any order and are one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posed, given, asked, held, last = [], [], None, 0, None

        def meet() -> None:
            nonlocal asked, held
            if posed and any(len(x[1]) for x in given):
                asked = asked or _Asked(k, posed)
                column = _Column(*(np.concatenate(x) for x in zip(*given, strict=True)))
                given.clear()
                held = 0
                asked.meet(column)

        for batch in batches:
            question = batch.column("mark").is_valid()
            if (rows := batch.filter(question)).num_rows:
                posed.append([rows.column(n).to_numpy() for n in ("id", "word", "pos", "mark")])
            rows = batch.filter(pc.invert(question))
            if "words" not in rows.schema.names:
                given.append([rows.column(n).to_numpy() for n in ("word", "id", "pos")])
                continue
            ids, sizes = rows.column("id").to_numpy(), pc.divide(pc.binary_length(rows.column("words")), 4).to_numpy()
            ends, at = np.cumsum(sizes), 0
            while at < len(ids):
                end = at + int(np.searchsorted(ends[at:], COLUMN_POSTINGS - held + (ends[at - 1] if at else 0)))
                if end == at and held and ids[at] != last:  # full, and no row of the same chunk follows
                    meet()
                    continue
                end = min(max(end, at + 1), len(ids))
                part = rows.slice(at, end - at)
                given.append([_numbers(part.column("words")), ids[at:end], _numbers(part.column("places")), sizes[at:end]])
                held, last, at = held + int(sizes[at:end].sum()), ids[end - 1], end
        meet()
        if asked:
            yield from asked.drain()

    return run


def best(asked: DataFrame, postings: DataFrame, k: int, parts: int) -> DataFrame:
    """``question_id, chunk_id, score``: of every task, the ``k`` chunks of greatest density of each question, ties by chunk.

    ``asked(question_id, alt, unit, excluded, place, word)``, ``postings(word, chunk_id, pos)`` or ``postings(chunk_id, n, words, places)``.
    A block of questions meets the postings in up to ``parts`` tasks. A task takes whole chunks in columns, the longest first, so that what a
    question has found bounds what it looks at next. Rows of single words are too many to sort, so then a task is one column.
    """
    packed = "words" in postings.columns
    rows = (postings.agg(F.sum("n")).first()[0] or 0) if packed else postings.count()
    forms = asked.select("question_id").distinct().count()
    tasks = max(1, min(parts, -(-rows // LEAST_POSTINGS)), 0 if packed else -(-rows // COLUMN_POSTINGS))
    blocks = max(1, -(-forms // BLOCK_QUESTIONS))
    block, task = F.pmod(F.xxhash64("question_id"), F.lit(blocks)), F.pmod(F.xxhash64("chunk_id"), F.lit(tasks))
    mark = F.col("alt").cast("long") * (1 << 32) + F.col("unit") * 2 + F.col("excluded").cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, tiles, key, word, pos, mark, *more: df.select(F.explode(tiles).alias("tile"), word.cast("long").alias("word"), F.col(key).cast("long").alias("id"), pos.cast("int").alias("pos"), mark.alias("mark"), *more)
    left = row(asked, F.sequence(block * tasks, block * tasks + tasks - 1), "question_id", F.col("word"), F.col("place"), mark, *([none("long").alias("n"), none("binary").alias("words"), none("binary").alias("places")] if packed else []))
    spread = F.sequence(task, task + (blocks - 1) * tasks, F.lit(tasks).cast("long"))
    if packed:  # rows of one chunk stay together, so they count as long as all of them
        several = postings.groupBy("chunk_id").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("chunk_id", "_n")
        sized = postings if several.isEmpty() else postings.join(several, "chunk_id", "left").withColumn("n", F.coalesce("_n", "n"))
        right = row(sized, spread, "chunk_id", none("long"), none("int"), none("long"), F.col("n").cast("long").alias("n"), "words", "places")
    else:
        right = row(postings, spread, "chunk_id", F.col("word"), F.col("pos"), none("long"))
    dealt = left.unionByName(right).repartitionById(blocks * tasks, F.col("tile").cast("int")).drop("tile")
    dealt = dealt.sortWithinPartitions(F.desc_nulls_first("n"), "id").drop("n") if packed else dealt
    met = dealt.mapInArrow(_met(k), "question_id long, chunk_id long, score double")
    return met.select(F.col("question_id").cast(asked.schema["question_id"].dataType), F.col("chunk_id").cast(postings.schema["chunk_id"].dataType), "score")
