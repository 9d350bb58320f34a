"""Workbooks with the standard library: cells to .xlsx bytes and back, one workbook a document."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_MAIN, _REL = _NS["m"], _NS["r"]
_PKG = "http://schemas.openxmlformats.org/package/2006"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")
_STAMP = (1980, 1, 1, 0, 0, 0)  # equal cells give equal bytes


def letters(index: int) -> str:
    """0 -> A."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def position(ref: str) -> tuple[int, int]:
    """B3 -> (2, 1)."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def unique_titles(titles: list[str]) -> list[str]:
    """Titles of at most 31 characters, repeated ones with _2, _3 and so on; comparison without case."""
    used: set[str] = set()
    out = []
    for base in titles:
        title, n = base[:31], 2
        while title.lower() in used:
            tail = f"_{n}"
            title, n = base[: 31 - len(tail)] + tail, n + 1
        used.add(title.lower())
        out.append(title)
    return out


def workbook(sheets: list[tuple[str, list[tuple[int, int, str, int, int]]]]) -> bytes:
    """Sheets of (row, col, text, row_span, col_span) as .xlsx; all texts stay text, so nothing becomes a formula. No sheets give one empty sheet."""
    sheets = sheets or [("Sheet1", [])]
    titles = unique_titles([t for t, _ in sheets])
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, xml: z.writestr(zipfile.ZipInfo(name, _STAMP), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1)) + "</sheets></workbook>")
        for i, (_, cells) in enumerate(sheets, 1):
            rows: dict[int, list[str]] = {}
            merges = []
            for row, col, text, down, across in sorted(cells):
                ref = f"{letters(col)}{row + 1}"
                shown = escape(_BAD.sub("", text)).replace("\r", "&#13;")
                rows.setdefault(row, []).append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{shown}</t></is></c>')
                if down > 1 or across > 1:
                    merges.append(f'<mergeCell ref="{ref}:{letters(col + across - 1)}{row + down}"/>')
            body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in sorted(rows.items()))
            tail = f'<mergeCells count="{len(merges)}">{"".join(merges)}</mergeCells>' if merges else ""
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{tail}</worksheet>')
    return data.getvalue()


def read_workbook(content: bytes) -> Iterator[tuple[int, str, int, int, str, int, int]]:
    """sheet number, title, row, col, text, row_span, col_span of every cell with a text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]
        for i, name in enumerate(names, 1):
            root = ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml"))
            spans = {}
            for m in root.iterfind("m:mergeCells/m:mergeCell", _NS):
                (r0, c0), (r1, c1) = map(position, m.get("ref").split(":"))
                spans[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
            for c in root.iterfind("m:sheetData/m:row/m:c", _NS):
                row, col = position(c.get("r"))
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)) or (c.findtext("m:v", "", _NS))
                yield i, name, row, col, text, *spans.get((row, col), (1, 1))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    sheets = []
    for (_, title), part in rows.groupby(["page_number", "title"], sort=True):
        sheets.append((title, [(int(a), int(b), c, int(d), int(e)) for a, b, c, d, e in zip(part["row"], part["col"], part["text"], part["row_span"], part["col_span"])]))
    return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "content": [workbook(sheets)]})


def to_workbooks(cells: DataFrame) -> DataFrame:
    """doc_id, content (.xlsx): one sheet a page from doc_id, page_number, title, row, col, text, row_span, col_span.

    A document's cells meet in one task; null texts are left out, control characters a workbook cannot hold are dropped.
    """
    return cells.where("text is not null").groupBy("doc_id").applyInPandas(_build, "doc_id bigint, content binary")


def from_workbooks(books: DataFrame) -> DataFrame:
    """doc_id, page_number, title, row, col, text, row_span, col_span of every cell of the workbooks."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "page_number", "title", "row", "col", "text", "row_span", "col_span"]
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"]):
                yield pd.DataFrame([(doc, *cell) for cell in read_workbook(content)], columns=names)

    return books.select("doc_id", "content").mapInPandas(parse, "doc_id bigint, page_number int, title string, row int, col int, text string, row_span int, col_span int")


def save_workbooks(books: DataFrame, folder: str) -> DataFrame:
    """Write each workbook to a folder that all executors share; doc_id, path, bytes."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                paths.append(f"{folder}/{doc}.xlsx")
                with open(paths[-1] + ".part", "wb") as f:  # a lost task leaves no half file under the final name
                    f.write(content)
                os.replace(paths[-1] + ".part", paths[-1])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "path": paths, "bytes": batch["content"].map(len)})

    return books.select("doc_id", "content").mapInPandas(save, "doc_id bigint, path string, bytes bigint")


def open_workbooks(spark, folder: str) -> DataFrame:
    """doc_id, content of the workbooks of a folder, the id being the file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    return files.select(F.regexp_extract("path", r"([0-9]+)\.xlsx$", 1).cast("bigint").alias("doc_id"), "content")
