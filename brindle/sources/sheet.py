"""Sheets of workbooks and CSV files as rows of text cells, without a spreadsheet library."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.functions.text import normal_headers

from .files import extracted, store_of

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes) -> tuple[str, list[tuple[int, list[str]]]]:
    """Name and rows (number, cells) of a workbook's first sheet; all cells as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        name = book.find("m:sheets/m:sheet", _NS).get("name", "Sheet1")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group(0)))
        rows = []
        for i, row in enumerate(ElementTree.fromstring(z.read(sheets[0])).findall("m:sheetData/m:row", _NS), 1):
            cells: list[str] = []
            for c in row.findall("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                v = c.find("m:v", _NS)
                if c.get("t") == "s" and v is not None:
                    cells.append(shared[int(v.text)])
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                else:
                    cells.append(v.text if v is not None and v.text else "")
            rows.append((int(row.get("r", i)), cells))
    return name, rows


def sheet_rows(path: str, content: bytes) -> Iterator[dict]:
    """Rows of a file: sheet, headers, row_number and cells by position. The first row is the header; a file without rows below it is an error."""
    if path.lower().endswith(".csv"):
        text = content.decode("utf-8-sig", "replace")
        name, rows = "Sheet1", list(enumerate(csv.reader(io.StringIO(text)), 1))
    else:
        name, rows = workbook_rows(content)
    if len(rows) < 2:
        raise ValueError("the sheet has no rows")
    width = max(len(r) for _, r in rows)
    head = rows[0][1] + [""] * (width - len(rows[0][1]))
    headers = normal_headers(head)
    for number, cells in rows[1:]:
        yield {"sheet": name, "headers": headers, "row_number": number, "cells": cells + [""] * (width - len(cells))}


def sheets(files: DataFrame) -> DataFrame:
    """path, error, sheet, headers, row_number, cells of all files' first sheets; one task reads a file."""
    return extracted(files, sheet_rows, "sheet string, headers array<string>, row_number int, cells array<string>")


def one_sheet(rows: DataFrame) -> DataFrame:
    """Rows of a single file as columns named by its headers and _row_number."""
    headers = rows.select("headers").first()[0]
    return rows.select(F.col("row_number").alias("_row_number"), *[F.col("cells")[i].alias(h) for i, h in enumerate(headers)])


class SheetSource(DataSource):
    """spark.read.format("sheet").load(path): the first sheet of a workbook or CSV file, or of all in a folder, all columns text. A task reads a file; the headers are those of the first one."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _files(self) -> list[str]:
        files, path = store_of(self.options["path"])
        if files.get_file_info(path).type != pyarrow.fs.FileType.Directory:
            return [path]
        inside = files.get_file_info(pyarrow.fs.FileSelector(path))
        return sorted(x.path for x in inside if x.is_file and not x.base_name.startswith(("_", ".")) and x.size)

    def _content(self, path: str) -> bytes:
        with store_of(self.options["path"])[0].open_input_stream(path) as f:
            return f.read()

    def schema(self) -> str:
        first = self._files()[0]
        row = next(sheet_rows(first, self._content(first)))
        return "_row_number int, " + ", ".join(f"`{h.replace('`', '``')}` string" for h in row["headers"])

    def reader(self, schema) -> DataSourceReader:
        source, width = self, len(schema.fields) - 1

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(path) for path in source._files()]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                for r in sheet_rows(partition.value, source._content(partition.value)):
                    yield (r["row_number"], *(r["cells"] + [""] * width)[:width])

        return Reader()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
