"""A Python data source for the cells of XLSX workbooks, with the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def cells(raw: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, kind, value) of every cell that holds something; kind is number, text, boolean, error or formula."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_NS + "sheet")]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_NS + "t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_NS + "si")]
        for k, name in enumerate(names, 1):
            for c in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter(_NS + "c"):
                letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                column = 0
                for letter in letters:
                    column = column * 26 + ord(letter) - 64
                value, kind = c.findtext(_NS + "v"), c.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(_NS + "t"))
                if c.find(_NS + "f") is not None and value is None:
                    yield name, int(row), column, "formula", ""
                elif value is not None:
                    text = shared[int(value)] if kind == "s" else value
                    yield name, int(row), column, {"s": "text", "inlineStr": "text", "str": "text", "b": "boolean", "e": "error"}.get(kind, "number"), text


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, kind, value) of all workbooks under path, a file a row of Spark's own binary reader."""
    import pandas as pd

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in cells(bytes(content))], columns=["path", "sheet", "row", "col", "kind", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(each, "path string, sheet string, row int, col int, kind string, value string")


def choose_sheet(found: DataFrame, sheet: str | None = None) -> DataFrame:
    """The cells of the sheet asked for, else of the one called materials, else of the only one; several are an error."""
    names = [r.sheet for r in found.select("sheet").distinct().limit(100).collect()]
    pick = sheet or next((n for n in names if n.lower() == "materials"), names[0] if len(names) == 1 else None)
    if pick not in names:
        raise ValueError(f"which sheet? {sorted(names)}")
    return found.where(F.col("sheet") == pick)
