"""Chunkers: order-dependent folds over a document's elements, run in Arrow batches per document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values.
WINDOW, OVERLAP = 1000, 200
TARGET, LEAST, MOST = 200, 40, 256
CARRY = 64
YIELDED = 4096
JOINER = "\n\n"
PREFIX_SHARE = 0.25


def tokens_of(text: str) -> int:
    """The fallback token count: a quarter of the characters, one at least."""
    return max(1, -(-len(text) // 4)) if text else 0


def legacy_windows(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    """Sliding windows, shortened to the last full stop or newline in their second half.

    The last window may be a pure suffix of the one before it; that is part of the behaviour.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + size)
        if at + size < len(text):
            cut = max(text.rfind(".", at, stop), text.rfind("\n", at, stop))
            if cut - at > size // 2:
                stop = cut + 1
        if piece := text[at:stop].strip():
            out.append(piece)
        at = (stop if at + size < len(text) else at + size) - overlap
    return out


def sentence_prefix(text: str, budget: int) -> str:
    """Longest prefix of whole sentences within ``budget`` tokens; a cut by characters if not one fits."""
    if budget <= 0 or not text:
        return ""
    if tokens_of(text) <= budget:
        return text
    best = ""
    for end in (m.end() for m in re.finditer(r"[.!?](?=\s|$)|\n", text)):
        part = text[:end].strip()
        if part and tokens_of(part) > budget:
            break
        best = part or best
    return best or text[: 4 * budget].strip()


def _pieces(text: str, room: int) -> list[str]:
    """``text`` in parts of at most ``room`` tokens that end at sentences where possible; joined, they are the text."""
    out: list[str] = []
    for segment in re.findall(r".*?(?:[.!?](?=\s)|\n|\Z)", text, re.S):
        while segment:
            if out and tokens_of(out[-1] + segment) <= room:
                out[-1] += segment
                break
            if tokens_of(segment) <= room:
                out.append(segment)
                break
            out.append(segment[: 4 * room])
            segment = segment[4 * room :]
    return [p for p in out if p]


def structure_chunks(elements: list[dict]) -> list[dict]:
    """Chunks of elements ``{kind, content, path, page}``: groups of one path, page and class, filled to the target.

    Prose merges up to the target (up to the cap while the chunk is small); a long paragraph is split at sentences; lists
    split between items, tables between rows with the header repeated, and neither merges with anything.
    """
    out: list[dict] = []

    def emit(text: str, element: dict, how: str) -> None:
        if text.strip():
            out.append({"content": text, "path": element["path"], "page": element["page"], "how": how, "tokens": tokens_of(text)})

    def prefix(path: str) -> str:
        steps = [s for s in path.split(" > ") if s]
        while steps and tokens_of(" > ".join(steps)) > PREFIX_SHARE * MOST:
            steps = steps[1:]
        return " > ".join(steps) + JOINER if steps else ""

    held: list[dict] = []

    def flush() -> None:
        if held:
            emit(prefix(held[0]["path"]) + JOINER.join(e["content"] for e in held), held[0], "merge" if len(held) > 1 else "element")
            held.clear()

    def rows(element: dict, lines: list[str], head: str, how: str) -> None:
        group: list[str] = []
        for line in lines:
            if group and tokens_of(head + "\n".join([*group, line])) > MOST:
                emit(head + "\n".join(group), element, how)
                group = []
            group.append(line)
        if group:
            emit(head + "\n".join(group), element, how)

    for element in elements:
        kind, text, head = element["kind"], element["content"], prefix(element["path"])
        if kind == "heading":
            flush()
        elif kind == "table":
            flush()
            lines = text.split("\n")
            rows(element, lines[1:] or lines, head + (lines[0] + "\n" if len(lines) > 1 else ""), "table")
        elif kind == "list":
            flush()
            rows(element, text.split("\n"), head, "list")
        elif tokens_of(head + text) > MOST:
            flush()
            for part in _pieces(text, max(1, MOST - tokens_of(head))):
                emit(head + part, element, "split")
        else:
            if held and (held[0]["path"], held[0]["page"]) != (element["path"], element["page"]):
                flush()
            if held:
                now = tokens_of(head + JOINER.join(e["content"] for e in held))
                then = tokens_of(head + JOINER.join([e["content"] for e in held] + [text]))
                if not (then <= TARGET or (now < LEAST and then <= MOST)):
                    flush()
            held.append(element)
    flush()
    return out


def legacy(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chunk_index, content`` by sliding windows."""

    @F.pandas_udf(ArrayType(StringType()))
    def windows(column: pd.Series) -> pd.Series:
        return column.map(lambda t: legacy_windows(t or ""))

    return docs.select(key, F.posexplode(windows(text)).alias("chunk_index", "content"))


def structured(elements: DataFrame, key: str = "document_id") -> DataFrame:
    """``key, chunk_index, content, how, tokens`` from ``key, seq, kind, content, path, page``.

    A document's elements are gathered into one array row, so batches stream and no group is held as a frame. Python objects are made
    of one document at a time and chunks handed on after ``YIELDED``, so memory does not grow with the documents of a batch.
    """
    fields = F.struct("seq", "kind", "content", "path", "page")
    rows = elements.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("elements"))

    names, types = [key, "chunk_index", "content", "how", "tokens"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def shaped(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                k, items = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                out += [(k, i, chunk["content"], chunk["how"], chunk["tokens"]) for i, chunk in enumerate(structure_chunks(items))]
                if len(out) >= YIELDED:
                    yield shaped(out)
                    out = []
            yield shaped(out)

    return rows.mapInArrow(run, f"{key} bigint, chunk_index bigint, content string, how string, tokens bigint")
