"""Sinks: review workbooks, JSON, text reports, append-only logs."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import cell_text
from .formats import letters

#: a sheet has no more rows than this; a workbook is for people, not for bulk
MOST_ROWS = 1_048_575
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _sheet(header: list[str], rows) -> str:
    def line(r, values):
        return f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(values, 1)) + "</row>"

    body = "".join(line(i, v) for i, v in enumerate([header, *rows], 1))
    return f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def workbook(tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None, most_rows: int = 100_000) -> bytes:
    """Review tables as XLSX bytes. A workbook is bounded: a longer table is
    refused, not cut; write it with :func:`write_table` instead."""
    out = io.BytesIO()
    names = list(tables)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, name in enumerate(names, 1):
            df = tables[name]
            cols = (order or {}).get(name, df.columns)
            kinds = dict(df.dtypes)
            rows = df.select(*(cell_text(F.col(c), kinds[c]).alias(c) for c in cols)).limit(most_rows + 1).collect()
            if len(rows) > min(most_rows, MOST_ROWS):
                raise ValueError(f"{name} has over {most_rows} rows")
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(list(cols), rows))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
    return out.getvalue()


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """A table of any size, by Spark's own writers and commit protocol."""
    df.write.mode("overwrite").format(kind).save(path)


def write_report(df: DataFrame, path: str, text: str = "report") -> None:
    df.select(text).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Events at the end of a log of JSON lines."""
    df.write.mode("append").json(path)


def upsert_table(old_path: str, df: DataFrame, keys: list[str], new_path: str) -> None:
    """The table at ``old_path`` with rows replaced by key, as a new version."""
    from ..operators.compare import upsert

    upsert(df.sparkSession.read.schema(df.schema).parquet(old_path), df, keys).write.mode("error").parquet(new_path)
