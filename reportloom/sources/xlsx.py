"""Workbooks as rows of cells, read with the standard library inside Spark tasks."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from itertools import batched
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sheet_no int, sheet string, row_no long, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _number(text: str) -> str:
    value = Decimal(text)
    if value == value.to_integral_value():
        return str(int(value))
    return format(value.quantize(Decimal("0.0001"), ROUND_HALF_UP).normalize(), "f")


def _date(text: str) -> str:
    moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(text) * 86400))
    return moment.strftime("%Y-%m-%d %H:%M" if moment.hour or moment.minute else "%Y-%m-%d")


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


class Workbook:
    """One workbook, of which only what is asked for is parsed; ``file`` is anything seekable."""

    def __init__(self, file):
        self.book = zipfile.ZipFile(file)
        self.names = set(self.book.namelist())
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        found = self._xml("xl/workbook.xml").iter(f"{_MAIN}sheet")
        #: Name (empty for none) and part of each sheet, in order.
        self.sheets = [((s.get("name") or "").strip(), targets[s.get(f"{_REL}id")].lstrip("/")) for s in found]
        self._shared: list[str] | None = None
        self._dates: list[bool] = []

    def _xml(self, name: str):
        return ElementTree.fromstring(self.book.read(name))

    def _load(self) -> None:
        self._shared = []
        if "xl/sharedStrings.xml" in self.names:
            self._shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in self._xml("xl/sharedStrings.xml")]
        if "xl/styles.xml" in self.names:
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
            for xf in styles.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf"):
                i = int(xf.get("numFmtId", 0))
                self._dates.append(i in DATE_FORMATS or bool(re.search("[dmyhs]", plain(own.get(i, "")), re.I)))

    def _cell(self, c) -> str:
        kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif v is None or v.text is None:
            return ""
        elif kind == "s":
            text = self._shared[int(v.text)]
        elif kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        elif kind == "n":
            style = int(c.get("s", 0))
            return _date(v.text) if style < len(self._dates) and self._dates[style] else _number(v.text)
        else:
            text = v.text
        return re.sub(r"[\r\n]", " ", text).strip()

    def rows(self, target: str) -> list[list[str]]:
        """The filled rows of a sheet's part, all as wide as its last filled column."""
        if self._shared is None:
            self._load()
        rows = []
        with self.book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    cells.append(self._cell(c))
                if any(cells):
                    rows.append(cells)
                row.clear()
        width = max((k + 1 for cells in rows for k, v in enumerate(cells) if v), default=0)
        return [(cells + [""] * width)[:width] for cells in rows]


def read_workbook(content: bytes, wanted: set[str] | None = None, skipped: list[str] | None = None):
    """Yields (sheet number, name, row number, cells); unwanted sheets are not parsed, their names go to ``skipped``."""
    book = Workbook(io.BytesIO(content))
    emitted = 0
    for name, target in book.sheets:
        name = name or f"Sheet{emitted + 1}"
        if wanted is not None and name.lower() not in wanted:
            if skipped is not None:
                skipped.append(name)
            continue
        rows = book.rows(target)
        for n, cells in enumerate(rows):
            yield emitted, name, n, cells
        emitted += bool(rows)


def read(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """Rows of all workbooks under ``path``: path, sheet_no, sheet, row_no, cells.

    Blank rows and sheets without rows are skipped, trailing empty columns are
    cut, ragged rows are filled. ``sheets`` (any case, trimmed) prunes sheets
    before they are parsed; a workbook that has none of them, or no filled row at
    all, raises with its path. One file is one unit of work; legacy ``.xls`` is
    refused.
    """
    wanted = None if sheets is None else {s.strip().lower() for s in sheets}

    def run(batches):
        kind = pa.list_(pa.string())
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if name.lower().endswith(".xls"):
                    raise ValueError(f"{name}: the legacy binary workbook format is not supported")
                skipped, found = [], False
                for part in batched(read_workbook(content.as_py(), wanted, skipped), 10_000):
                    found = True
                    no, sheet, row, cells = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(no)), pa.array(no, pa.int32()), pa.array(sheet), pa.array(row, pa.int64()), pa.array(cells, kind)],
                        ["path", "sheet_no", "sheet", "row_no", "cells"],
                    )
                if not found:
                    asked = f" in the sheets {sorted(wanted)}; other sheets: {', '.join(skipped) or 'none'}" if wanted is not None else ""
                    raise ValueError(f"{name}: no filled row{asked}")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.xlsx?$") & (F.col("length") > 0))
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def as_grid(rows: DataFrame) -> DataFrame:
    """Workbook rows in the shape that ``tables.normalize`` takes: one block per sheet."""
    return rows.select(F.col("path").alias("doc_id"), F.col("sheet_no").alias("block_no"), "sheet", "row_no", "cells")
