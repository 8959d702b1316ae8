"""Workbooks as a data source: ``spark.read.format("xlsx").load(folder)``.

A task reads one sheet of one file, and of the file no more than its table of contents,
the strings and styles that its sheets share, and that sheet. Filters on ``sheet`` and
``path`` by equality or a list are pushed down: sheets that they rule out get no task.

Files are opened with Arrow's file systems (local, HDFS, S3, GCS). Where only Spark can
open a path, :func:`reportloom.sources.xlsx.read` reads it, a file a task.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from reportloom.sources.xlsx import SCHEMA, Workbook, read_workbook

#: Files whose tables of contents are read at a time while a query is planned.
OPEN = 32


@dataclass
class Sheet(InputPartition):
    """A sheet by its place in the workbook, or all sheets (None)."""

    path: str
    place: int | None


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1:
                continue  # no column is ever null
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in ("sheet", "path"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def _keeps(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def _files(self) -> list[str]:
        where, path = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))
        if where.get_file_info(path).type == fs.FileType.File:
            found = [path]
        else:
            found = [f.path for f in where.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.size]
        legacy = [f for f in found if f.lower().endswith(".xls")]
        if legacy:
            raise ValueError(f"{legacy[0]}: the legacy binary workbook format is not supported")
        return sorted(f for f in found if fnmatch.fnmatch(f.lower(), "*.xlsx") and self._keeps("path", f))

    def _open(self, path: str):
        where, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))
        return where.open_input_file(path)

    def _sheets(self, path: str) -> list[Sheet]:
        with self._open(path) as file:
            names = [name for name, _ in Workbook(file).sheets]
        if not all(names):  # a sheet without a name is called by its number among the filled ones
            return [Sheet(path, None)]
        return [Sheet(path, k) for k, name in enumerate(names) if self._keeps("sheet", name)]

    def partitions(self) -> list[Sheet]:
        with ThreadPoolExecutor(OPEN) as pool:
            return [sheet for sheets in pool.map(self._sheets, self._files()) for sheet in sheets]

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no sheets to read
            return
        with self._open(partition.path) as file:
            if partition.place is None:
                rows = [r for r in read_workbook(file.read()) if self._keeps("sheet", r[1])]
            else:
                book = Workbook(file)
                name, target = book.sheets[partition.place]
                rows = [(partition.place, name, n, cells) for n, cells in enumerate(book.rows(target))]
        for part in batched(rows, 10_000):
            no, sheet, row, cells = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(no)), pa.array(no, pa.int32()), pa.array(sheet), pa.array(row, pa.int64()), pa.array(cells, pa.list_(pa.string()))],
                ["path", "sheet_no", "sheet", "row_no", "cells"],
            )


class WorkbookSource(DataSource):
    """Rows of all workbooks under a path: path, sheet_no (place in the workbook), sheet, row_no, cells.

    Blank rows are skipped, trailing empty columns cut, ragged rows filled. A sheet without a
    filled row gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes ``format("xlsx")`` known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
