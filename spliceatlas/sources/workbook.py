"""First sheet of an .xlsx workbook, read with the standard library on the driver (a workbook has at most 1,048,576 rows)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def is_workbook(path: str) -> bool:
    return path.lower().endswith(".xlsx")


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(path: str) -> list[list[str]]:
    """Cells as text, missing ones empty, all rows as wide as the widest."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
    out = []
    for row in sheet.iter(f"{_NS}row"):
        cells: dict[int, str] = {}
        for cell in row.iter(f"{_NS}c"):
            kind, value = cell.get("t"), cell.find(f"{_NS}v")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
            else:
                text = "" if value is None else value.text or ""
                text = shared[int(text)] if kind == "s" and text else text
            at = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells[at] = text
        out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """line, f as the text reader gives them, without the header row. Fields that hold tabs stay whole."""
    table = [(k, r) for k, r in enumerate(rows(path)[1:])]
    df = spark.createDataFrame(table, "n bigint, f array<string>")
    return df.selectExpr("struct('' as file, 0L as split, n as row) as line", "f")
