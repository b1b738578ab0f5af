"""Document files to typed elements: text and DOCX parsers, and a registry that takes others.

Elements are rows of ``ELEMENT``; heading paths follow the fold ``path[:level - 1] + [heading]``. A PDF parser is not part
of the package (none is installed); register one under ``pdf`` as a function from bytes to elements.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docweft.operators.answers import validate_bytes

ELEMENT = "seq bigint, kind string, content string, level int, path string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _with_paths(found: list[tuple[str, str, int | None]]) -> list[tuple[int, str, str, int | None, str]]:
    path: list[str] = []
    out = []
    for i, (kind, content, level) in enumerate(found):
        if kind == "heading":
            path = [*path[: (level or 1) - 1], content]
        out.append((i, kind, content, level, " > ".join(path)))
    return out


def parse_txt(data: bytes) -> list[tuple]:
    """Blank-line paragraphs of UTF-8 text (byte-order mark dropped); lines with 1 to 6 hashes are headings."""
    found: list[tuple[str, str, int | None]] = []
    for block in re.split(r"\n\s*\n", data.decode("utf-8-sig", "replace").replace("\r\n", "\n")):
        if not (text := block.strip()):
            continue
        mark = re.fullmatch(r"(#{1,6})\s+(.+)", text)
        found.append(("heading", mark.group(2).strip(), len(mark.group(1))) if mark else ("paragraph", text, None))
    return _with_paths(found)


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def parse_docx(data: bytes) -> list[tuple]:
    """Body paragraphs and tables of a DOCX file in order; styles named Heading and List give headings and lists."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ET.fromstring(package.read("word/document.xml")).find(f"{_W}body")
    found: list[tuple[str, str, int | None]] = []
    items: list[str] = []

    def flush() -> None:
        if items:
            found.append(("list", "\n".join(items), None))
            items.clear()

    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            flush()
            rows = [" | ".join(_text(cell) for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
            found.append(("table", "\n".join(rows), None))
        elif node.tag == f"{_W}p" and (text := _text(node).strip()):
            style = next((s.get(f"{_W}val") or "" for s in node.iter(f"{_W}pStyle")), "")
            if style.lower().startswith("list"):
                items.append(text)
                continue
            flush()
            level = re.fullmatch(r"heading ?(\d)", style.lower())
            found.append(("heading", text, int(level.group(1))) if level else ("paragraph", text, None))
    flush()
    return _with_paths(found)


def write_docx(paragraphs: list[tuple[str, str]]) -> bytes:
    """A minimal DOCX of ``(style, text)`` paragraphs, for exchange and tests."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(style)}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>' for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        package.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


#: Elements after which a task hands on what it has, so that memory does not grow with the files of a batch.
YIELDED = 4096

PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {"txt": parse_txt, "docx": parse_docx}


def extract(files: DataFrame, parsers: dict[str, Callable[[bytes], list[tuple]]] | None = None) -> DataFrame:
    """Elements of ``files(file_id, extension, content)`` with ``problem`` where a file is invalid or has no parser."""
    known = parsers or PARSERS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shaped = lambda out: pd.DataFrame(out, columns=["file_id", "seq", "kind", "content", "level", "path", "problem"]).astype({"seq": "Int64", "level": "Int64"})
        for frame in frames:
            out = []
            for file_id, extension, data in zip(frame["file_id"], frame["extension"], frame["content"], strict=True):
                problem = validate_bytes(data, extension) or ("" if extension in known else "no parser")
                if problem:
                    out.append((file_id, None, None, None, None, None, problem))
                else:
                    out += [(file_id, *element, None) for element in known[extension](data)]
                if len(out) >= YIELDED:
                    yield shaped(out)
                    out = []
            yield shaped(out)

    return files.select("file_id", "extension", "content").mapInPandas(run, f"file_id bigint, {ELEMENT}, problem string")
