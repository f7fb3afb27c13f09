"""Panel lists as they come: any header spelling, any unit, any of three delimiters.

Only the first lines of a file are looked at on the driver, to find the header; rows are read and typed by Spark.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators.statistics import upper_median

# Spellings of the standard fields, without units and in lower case.
SYNONYMS = {
    "name": ["name", "item", "product", "description", "item description", "品名", "名称"],
    "quantity": ["quantity", "qty", "count", "pcs", "数量", "件数"],
    "length": ["length", "len", "l", "长", "长度"],
    "width": ["width", "w", "宽", "宽度"],
    "height": ["height", "h", "高", "高度"],
    "weight": ["weight", "unit weight", "net weight", "gross", "gross weight", "单重", "重量"],
    "part_no": ["part_no", "part no", "sku", "sku code", "料号"],
    "category": ["category", "type", "类别"],
    "note": ["note", "remark", "备注"],
}
_UNIT = re.compile(r"[\s_(（]*(mm|cm|m|kgs?|g|t|lbs?)[)）.]*$")
_REQUIRED = ("quantity", "length", "width", "height", "weight")
_SUMMARY = r"(?i)^\s*(total|subtotal|sum|grand total|合计|总计|小计)\b?"


def delimiter(line: str) -> str:
    """Of semicolon, tab and comma the one that the line holds most of."""
    return max(";\t,", key=line.count)


def resolve(headers: list[str]) -> dict[str, tuple[int, str]]:
    """Field -> (column, unit). An exact spelling beats one with a unit beats one that only starts so; ties go to the left."""
    best: dict[str, tuple[int, int, str]] = {}
    for k, raw in enumerate(headers):
        key = raw.strip().lower().rstrip(".").replace("_", " ").strip()
        unit = (m := _UNIT.search(key)) and m[1] or ""
        bare = key[: m.start()].strip(" (") if unit else key
        for field, words in SYNONYMS.items():
            words = [w.replace("_", " ") for w in words]
            score = 3 if key in words else 2 if bare and bare in words else 1 if any(len(w) > 3 and key.startswith(w) for w in words) else 0
            if score and (field not in best or score > best[field][0]):
                best[field] = (score, k, unit if score < 3 or bare in words else "")
    return {field: (k, unit) for field, (_, k, unit) in best.items()}


def header_row(lines: list[list[str]]) -> int:
    """The row that names most required fields; the first of equals."""
    named = [sum(f in (found := resolve(row)) for f in _REQUIRED) + 0.5 * ("name" in found) for row in lines]
    return max(range(len(lines)), key=lambda k: (named[k], -k))


def _length(cell: Column, unit: str, metres: bool) -> Column:
    scale = numbers.LENGTH_UNITS.get(unit) or (1000.0 if metres else 1.0)
    return numbers.number(cell) * scale


def read_panel_list(spark: SparkSession, path: str) -> DataFrame:
    """Standard rows of a CSV panel list: name, qty_state, quantity, length_mm, width_mm, height_mm, weight_kg, part_no, category, note.

    A length column without a unit whose upper median is 25 or less is in metres. A weight's own unit goes before that of its column;
    ranges, forces and what is no weight are null. Blank, comment and summary rows are passed over.
    """
    top = [r.value.lstrip("﻿") for r in spark.read.text(path).limit(15).collect()]
    if not top:
        raise ValueError(f"{path}: no rows")
    sep = delimiter(max(top, key=lambda t: max(t.count(c) for c in ";\t,")))
    cells = [next(csv.reader([t], delimiter=sep), []) for t in top]  # quoted headers may hold the delimiter
    at = header_row(cells)
    headers = cells[at]
    fields = resolve(headers)
    columns = ", ".join(f"c{k} string" for k in range(len(headers)))
    rows = spark.read.csv(path, sep=sep, schema=columns, mode="PERMISSIVE", encoding="UTF-8").withColumn("_line", F.concat_ws("\x1f", *(f"c{k}" for k in range(len(headers)))))
    heads = ["\x1f".join(row) for row in cells[: at + 1]]
    rows = rows.where(~F.trim("_line").isin([h.strip() for h in heads] + ["﻿" + h.strip() for h in heads]))
    cell = lambda f: F.col(f"c{fields[f][0]}") if f in fields else F.lit(None).cast("string")
    first = F.coalesce(F.col("c0"), F.lit(""))
    rows = rows.where((F.trim(F.regexp_replace("_line", "\x1f", "")) != "") & ~first.startswith("#") & ~F.coalesce(cell("name"), first).rlike(_SUMMARY))
    unit = {f: fields.get(f, (0, ""))[1] for f in fields}

    def metres(f: str) -> bool:
        middle = upper_median(rows, [], numbers.number(cell(f))).first() if f in fields and not unit[f] else None
        return middle is not None and middle["upper_median"] <= 25

    q = numbers.quantity(cell("quantity"))
    weight = numbers.weight_kg(cell("weight"), numbers.WEIGHT_UNITS.get((unit.get("weight") or "kg").rstrip("s"), 1.0))
    return rows.select(
        F.trim(cell("name")).alias("name"), q["state"].alias("qty_state"), q["qty"].alias("quantity"), *(_length(cell(f), unit.get(f, ""), metres(f)).alias(f + "_mm") for f in ("length", "width", "height")), weight.alias("weight_kg"),
        *(cell(f).alias(f) for f in ("part_no", "category", "note")),
    )
