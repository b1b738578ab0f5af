"""Claims, verdicts, evidence choice and prompts: text rules whose steps depend on one another, as Python functions and pandas UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from docweft.functions import vocabulary as V

ABBREVIATIONS = {"e.g", "i.e", "etc", "dr", "mr", "mrs", "ms", "vs", "fig", "no", "st", "al", "approx"}
TOKEN = re.compile(r"[a-z0-9][a-z0-9.%/-]*")
CITATION = re.compile(r"\s*\[\d{1,2}\]")


def tokens(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text.lower()) if t not in V.CONTENT_STOPWORDS]


def sentences(text: str) -> list[str]:
    """Sentences with wrapped lines joined and abbreviations kept together."""
    text = re.sub(r"\n+(?=[a-z0-9(])", " ", text or "")
    out, start = [], 0
    for m in re.finditer(r"[.!?]+(?=\s)|\n+", text):
        word = re.search(r"([A-Za-z.]+)\.$", text[start : m.end()])
        if word and word.group(1).lower().rstrip(".") in ABBREVIATIONS:
            continue
        if piece := text[start : m.end()].strip():
            out.append(piece)
        start = m.end()
    if piece := text[start:].strip():
        out.append(piece)
    return out


def claims(answer: str) -> list[str]:
    """Claims of an answer: sentences of its lines without list marks; citations alone and fenced figures are none."""
    out, fenced = [], False
    for line in (answer or "").split("\n"):
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            for sentence in sentences(re.sub(r"^\s*(?:[-*•]|\d+[.)])\s+", "", line)):
                if tokens(CITATION.sub("", sentence)):
                    out.append(sentence)
    return out


def promote_parts(parts: list[str], passages: list[str]) -> list[int]:
    """Order of passages with the best one for each question part moved to the front."""
    left, front = list(range(len(passages))), []
    words = [set(tokens(p)) for p in passages]
    for part in parts:
        wanted = set(tokens(re.sub(V.COMMANDS, "", part)))
        if not wanted or any(wanted <= words[i] for i in front) or not left:
            continue
        best = max(left, key=lambda i: (len(wanted & words[i]), -left.index(i)))
        if wanted & words[best]:
            left.remove(best)
            front.append(best)
    return front + left


def fit_prompt(question: str, blocks: list[str], history: list[str], budget: int) -> dict:
    """Evidence as JSON lines within a byte budget; a repeated text is referred to; history takes what is left, newest first."""
    cost = lambda s: -(-len(s.encode()) // 2)
    used, lines, seen = cost(question), [], {}
    for i, block in enumerate(blocks, 1):
        line = json.dumps({"id": i, "same_as": seen[block]} if block in seen else {"id": i, "text": block}, ensure_ascii=False)
        if used + cost(line) > budget:
            kept = ""
            for sentence in sentences(block):
                if used + cost(json.dumps({"id": i, "text": (kept + " " + sentence).strip()}, ensure_ascii=False)) > budget:
                    break
                kept = (kept + " " + sentence).strip()
            if not kept:
                continue
            line = json.dumps({"id": i, "text": kept, "cut": True}, ensure_ascii=False)
        seen.setdefault(block, i)
        lines.append(line)
        used += cost(line)
    turns = []
    for turn in reversed(history):
        if used + cost(turn) > budget:
            break
        turns.insert(0, turn)
        used += cost(turn)
    return {"evidence": lines, "history": turns, "used": used}


def valid_diagrams(answer: str, evidence: str) -> list[bool]:
    """Per fenced figure, whether every labelled node is cited and its words are in the evidence."""
    out, known = [], set(tokens(evidence))
    for body in re.findall(r"```[a-z]*\n(.*?)```", answer or "", re.S):
        labels = re.findall(r"\[([^\[\]]+?)\s*(\[\d{1,2}\])?\]", body)
        out.append(bool(labels) and all(cite and set(tokens(label)) <= known for label, cite in labels))
    return out


def validate_bytes(data: bytes, extension: str) -> str:
    """Empty string for a file that is what its extension says, else the reason."""
    kind = extension.lower().lstrip(".")
    if not data:
        return "empty"
    if kind == "pdf":
        return "" if data[:5] == b"%PDF-" else "no pdf signature"
    if kind == "docx":
        import io
        import zipfile

        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "" if "[Content_Types].xml" in z.namelist() else "no docx parts"
        except zipfile.BadZipFile:
            return "no zip archive"
    if kind == "txt":
        return "" if data.count(b"\x00") <= 0.1 * len(data) else "binary text"
    return "unsupported"


def text_udf(fn, kind: str):
    """Pandas UDF over text columns from a plain function."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([fn(*values) for values in zip(*columns, strict=True)])

    return run
