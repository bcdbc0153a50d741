"""Spreadsheets: CSV text and typing with native expressions, XLSX cells and files in a kernel."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SHEETS, PREVIEW_ROWS, PREVIEW_COLUMNS, MAX_BYTES = 50, 12, 5, 25 * 1024**2
CELLS = "sheet_no int, sheet string, row int, col int, kind string, value string, formula string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def number_or_text(cell: Column) -> Column:
    """struct(number, text): only plain numbers are numbers; leading zeros, plus signs and more than 15 digits stay text."""
    plain = cell.rlike(r"^-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?$")
    return F.struct(F.when(plain, cell.cast("double")).alias("number"), F.when(~plain, cell).alias("text"))




def csv_text(content: Column) -> Column:
    """The text of CSV bytes: UTF-8 if valid (without its mark), else Windows-1252 with C1 controls for the five bytes it leaves open."""

    @F.pandas_udf("string")
    def windows(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in bytes(b)))

    utf8 = F.decode(content, "UTF-8")
    clean = F.when(utf8.startswith("﻿"), F.substring(utf8, 2, 2**31 - 1)).otherwise(utf8)
    return F.when(F.is_valid_utf8(content.cast("string")), clean).otherwise(windows(content))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_cells(data: bytes) -> Iterator[tuple]:
    """Rows of CELLS of a workbook. The inflated parts are bounded, so a small file cannot fill the memory."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > 20 * MAX_BYTES:
            raise ValueError("too-large-to-process")
        part = lambda name: ElementTree.fromstring(z.read(name))
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in part("xl/sharedStrings.xml").iter(_MAIN + "si")]
        targets = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        for number, sheet in enumerate(part("xl/workbook.xml").iter(_MAIN + "sheet")):
            target = targets[sheet.get(_REL + "id")].lstrip("/")
            for c in part(target if target.startswith("xl/") else f"xl/{target}").iter(_MAIN + "c"):
                ref, kind = c.get("r"), c.get("t", "n")
                v, f = c.find(_MAIN + "v"), c.find(_MAIN + "f")
                value = v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                kind = {"n": "number", "b": "boolean", "e": "error"}.get(kind, "text")
                row = int("".join(x for x in ref if x.isdigit())) - 1
                yield number, sheet.get("name"), row, _column(ref), kind, value, f.text if f is not None else None


def write_xlsx(rows: list[list[str | float | None]], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet; numbers as numbers, everything else as text."""
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref, n = "", c + 1
            while n:
                n, rest = divmod(n - 1, 26)
                ref = chr(65 + rest) + ref
            if isinstance(v, float | int):
                cells.append(f'<c r="{ref}{r}"><v>{v!r}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    main, rel = _MAIN[1:-1], _REL[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, body in parts.items():
            z.writestr(zipfile.ZipInfo(path), '<?xml version="1.0" encoding="UTF-8"?>' + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def cells(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, CELLS..., error): the cells of XLSX files; a file that cannot be read gives one row with an error code."""
    kind = dict(files.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in CELLS.split(", ")), "error"]
        for batch in batches:
            rows = []
            for k, data in batch.itertuples(index=False):
                try:
                    rows += [(k, *c, None) for c in xlsx_cells(bytes(data))]
                except (ValueError, KeyError, TypeError, IndexError, zipfile.BadZipFile, ElementTree.ParseError):
                    rows.append((k, *[None] * 7, "damaged"))
            yield pd.DataFrame(rows, columns=names).astype({"sheet_no": "Int32", "row": "Int32", "col": "Int32"})

    return files.select(key, content).mapInPandas(read, f"{key} {kind}, {CELLS}, error string")


def uncalculated(cell_rows: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, refuse): a formula without a saved value somewhere means that the file cannot become CSV."""
    return cell_rows.groupBy(key).agg(F.bool_or(F.col("formula").isNotNull() & F.col("value").isNull()).alias("refuse"))


def sheet_choice(n_sheets: Column, accepted: Column, target: Column) -> Column:
    """pass, confirm (CSV of one of several sheets) or convert."""
    return F.when(accepted | target.isNull(), "pass").when((target == "csv") & (n_sheets > 1), "confirm").otherwise("convert")
