"""Parsers of one file's bytes to blocks; small helpers of the Spark readers.

A block is a dict with the keys of ``BLOCK``; a parser yields them in order.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

BLOCK = "type string, line int, paragraph int, page int, sheet string, sheet_index int, table_index int, row int, col int, cell string, text string, confidence double"
BLOCK_FIELDS = tuple(f.split(" ")[0] for f in BLOCK.split(", "))

# fixed values: namespaces of Office files
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# fixed values: how much a block of each origin is trusted
CONFIDENCE = {"txt": 1.0, "docx": 0.98, "xlsx_cell": 0.98, "xlsx_row": 0.96, "pdf_stream": 0.72}


def block(kind: str, text: str, confidence: float, **where) -> dict:
    return dict.fromkeys(BLOCK_FIELDS) | where | {"type": kind, "text": " ".join(text.split()), "confidence": confidence}


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else GB 18030, else Latin-1."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def text_blocks(data: bytes) -> Iterator[dict]:
    for i, line in enumerate(decode(data).splitlines(), 1):
        yield block("paragraph", line, CONFIDENCE["txt"], line=i)


def csv_blocks(data: bytes) -> Iterator[dict]:
    for r, row in enumerate(csv.reader(io.StringIO(decode(data))), 1):
        for c, value in enumerate(row, 1):
            yield block("sheet_cell", value, CONFIDENCE["xlsx_cell"], sheet="csv", sheet_index=1, row=r, col=c, cell=f"{letters(c)}{r}")


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def number(ref: str) -> int | None:
    n = 0
    for ch in re.match("[A-Z]*", ref.upper().replace("$", ""))[0]:
        n = n * 26 + ord(ch) - 64
    return n or None


def _runs(element) -> str:
    parts = []
    for e in element.iter():
        if e.tag == f"{WORD}t":
            parts.append(e.text or "")
        elif e.tag in (f"{WORD}tab", f"{WORD}br"):
            parts.append(" ")
    return "".join(parts)


def docx_blocks(data: bytes) -> Iterator[dict]:
    """Body paragraphs, then tables by cell and row, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        for i, p in enumerate(body.findall(f"{WORD}p"), 1):
            yield block("paragraph", _runs(p), CONFIDENCE["docx"], paragraph=i)
        for t, table in enumerate(body.iter(f"{WORD}tbl"), 1):
            for r, row in enumerate(table.findall(f"{WORD}tr"), 1):
                values = [_runs(c) for c in row.findall(f"{WORD}tc")]
                for c, value in enumerate(values, 1):
                    yield block("table_cell", value, CONFIDENCE["docx"], table_index=t, row=r, col=c)
                yield block("table_row", " | ".join(" ".join(v.split()) for v in values if v.strip()), CONFIDENCE["docx"], table_index=t, row=r)
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
            for i, p in enumerate(ET.fromstring(z.read(name)).iter(f"{WORD}p"), 1):
                yield block("paragraph", _runs(p), CONFIDENCE["docx"], paragraph=i, sheet=name[5:-4])


def sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Name and part of each worksheet in order; those without a target are left out."""
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    have = set(z.namelist())
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
        part = targets.get(s.get(f"{RELATION}id"), "").lstrip("/")
        part = part if part.startswith("xl/") else f"xl/{part}"
        if part in have:
            yield s.get("name", ""), part


def sheet_cells(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    at_row = 0
    for row in ET.fromstring(z.read(part)).iter(f"{SHEET}row"):
        at_row, at_col = int(row.get("r") or at_row + 1), 0
        for c in row.findall(f"{SHEET}c"):
            at_col = number(c.get("r") or "") or at_col + 1
            v, kind = c.find(f"{SHEET}v"), c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = shared[int(v.text)] if int(v.text) < len(shared) else ""
            else:
                value = v.text
            if value.strip():
                yield at_row, at_col, value


def xlsx_blocks(data: bytes) -> Iterator[dict]:
    """Cells and non-empty rows of every sheet; a formula gives its stored value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        for k, (name, part) in enumerate(sheets(z), 1):
            rows: dict[int, list[str]] = {}
            for r, c, value in sheet_cells(z, part, shared):
                rows.setdefault(r, []).append(" ".join(value.split()))
                yield block("sheet_cell", value, CONFIDENCE["xlsx_cell"], sheet=name, sheet_index=k, row=r, col=c, cell=f"{letters(c)}{r}")
            for r, values in sorted(rows.items()):
                yield block("table_row", " | ".join(values), CONFIDENCE["xlsx_row"], sheet=name, sheet_index=k, row=r)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_literal(raw: bytes) -> str:
    def one(m):
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S).decode("latin-1")


def pdf_blocks(data: bytes) -> Iterator[dict]:
    """Text shown by the content streams, plain or deflated, one block a stream."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    for page, m in enumerate(re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S), 1):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        shown = []
        for t in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*Tj|\[((?:\\.|[^\]])*)\]\s*TJ", body, re.S):
            shown += [pdf_literal(t[1])] if t[1] is not None else ["".join(pdf_literal(x) for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)", t[2], re.S))]
        yield block("page_text", " ".join(shown), CONFIDENCE["pdf_stream"], page=page)


PARSERS = {"txt": text_blocks, "csv": csv_blocks, "docx": docx_blocks, "xlsx": xlsx_blocks, "xlsm": xlsx_blocks, "pdf": pdf_blocks}


def parse(name: str, data: bytes) -> tuple[str, str | None, list[dict]]:
    """(status, error, blocks) of a file; a failure is a row, never an exception."""
    parser = PARSERS.get(name.rpartition(".")[2].lower())
    if parser is None:
        return "skipped", "no parser for this format", []
    try:
        found = [b for b in parser(data) if b["text"]]
    except Exception as e:  # any damaged file
        return "failed", f"{type(e).__name__}: {e}"[:500], []
    return ("success" if found else "low_quality"), None, found
