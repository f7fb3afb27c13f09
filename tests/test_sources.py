import io
import zipfile

import pytest

from pyspark.sql import functions as F

from lodestow.sources import ledger_sheets, panels, workbook


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("item,qty,length_cm,width_cm,height_cm,weight,sku\nbox,3,120,80,60,15,A1\n", ("box", 3, 1200.0, 800.0, 600.0, 15.0)),
        ("品名;数量;长;宽;高;单重\nbox;3;1200;800;600;15\n", ("box", 3, 1200.0, 800.0, 600.0, 15.0)),
        ("name\tqty\tlength (m)\twidth_mm\tH_mm\tweight_t\nbox\t3 EA\t1.2\t800\t600\t0.015\n", ("box", 3, 1200.0, 800.0, 600.0, 15.0)),
        ("List of 2024,,,,,\nname,quantity,length,width,height,weight\nbox,3,1.2,0.8,0.6,15\n# note,,,,,\n,,,,,\nTOTAL,3,,,,15\n", ("box", 3, 1200.0, 800.0, 600.0, 15.0)),
    ],
)
def test_panel_list(spark, tmp_path, body, expected):
    path = tmp_path / "list.csv"
    path.write_text("﻿" + body, encoding="utf-8")
    got = rows(panels.read_panel_list(spark, str(path)))
    assert len(got) == 1
    assert (got[0]["name"], got[0]["quantity"], got[0]["length_mm"], got[0]["width_mm"], got[0]["height_mm"], round(got[0]["weight_kg"], 6)) == expected


def test_header_ties_go_left():
    assert panels.resolve(["qty", "count"])["quantity"][0] == 0


def test_workbook(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>2.5</v></c><c r="C1"><f>A1</f></c><c r="D1" t="e"><v>#REF!</v></c></row></sheetData></worksheet>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Materials" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "a.xlsx").write_bytes(raw.getvalue())
    found = workbook.choose_sheet(workbook.read_cells(spark, str(tmp_path)))
    assert {(r.row, r.col, r.kind, r.value) for r in found.collect()} == {(1, 1, "text", "name"), (1, 28, "number", "2.5"), (1, 3, "formula", ""), (1, 4, "error", "#REF!")}


def test_weights_by_their_own_unit_and_quoted_headers(spark, tmp_path):
    f = tmp_path / "list.csv"
    f.write_text('"Item, long",Qty,Length (mm),Width (mm),Height (mm),Weight (t)\nbeam,2,6000,200,100,1.5\nplate,1,900,800,12,800 kg\njack,1,300,200,200,15 kN\ncrate,1,300,200,200,1-2\n')
    got = panels.read_panel_list(spark, str(f)).collect()
    assert [r.name for r in got] == ["beam", "plate", "jack", "crate"]
    assert [r.weight_kg for r in got] == [1500.0, 800.0, None, None]
    assert [r.length_mm for r in got] == [6000.0, 900.0, 300.0, 300.0]
    assert [r.quantity for r in got] == [2, 1, 1, 1]


def sheet(spark, lines, doc="d"):
    return spark.createDataFrame([(doc, r + 1, c + 1, v) for r, line in enumerate(lines) for c, v in enumerate(line)], "doc string, row int, col int, raw string")


LEDGER = [
    ["Packing list"], ["箱号 Case No", "品名 / Description", "Qty", "Net weight (kg)", "毛重(lb)", "L x W x H cm", "unit"],
    ["C1", "Panel", "12 pcs", "1,200", "10", "120x80x60", ""], ["C2", "Panel", "3", "50.5", "5 kg", "120x80", "set"], ["Subtotal", "", "15", "1250.5", ""],
    ["C3", "Rail", "7 米", "8", "-", "1x2x3"], [None, " "], ["小计", "", "7", "9"], ["总计 Grand Total", "", "22", "1258.5"],
    ["Case No", "Gross total kg", "name", "qty", "数量", "unit"], ["C9", "5", "bolt", "3", "4"], ["C8", "about 5", "bolt", "", ""], ["Total", "6"],
]


def test_ledger_rows_and_totals_apart(spark):
    rows, totals = ledger_sheets.assemble(sheet(spark, LEDGER).unionByName(sheet(spark, [["no header", "1"], ["Total", "1"]], "e")), "doc")
    got = {r.package_id: r for r in rows.collect()}
    assert set(got) == {"C1", "C2", "C3", "C9", "C8"}
    assert [(got[c].block, got[c].section) for c in ("C1", "C2", "C3", "C9")] == [(0, 0), (0, 0), (0, 1), (1, 3)]
    assert (got["C1"].quantity, got["C1"].unit, got["C1"].length_mm, got["C1"].gross_kg) == (12, "pcs", 1200, 4.5359237)
    assert (got["C2"].quantity, got["C2"].unit, got["C2"].gross_kg, got["C2"].reasons["gross_kg"]) == (3, "set", None, "unit_conflict")
    assert got["C2"].length_mm is None and got["C3"].unit == "米" and got["C3"].gross_kg is None and "gross_kg" not in got["C3"].reasons
    assert got["C9"].quantity is None and got["C9"].reasons == {"quantity": "several_columns"}
    assert got["C8"].gross_kg is None and got["C8"].reasons["gross_kg"] == "unclear"
    assert {(r.row, r.field): (r.kind, r.stated, r.n_rows, r.summed, r.status) for r in totals.collect()} == {
        (5, "quantity"): ("section", 15, 2, 15, "match"), (5, "net_kg"): ("section", 1250.5, 2, 1250.5, "match"), (8, "quantity"): ("section", 7, 1, 7, "match"), (8, "net_kg"): ("section", 9, 1, 8, "mismatch"),
        (9, "quantity"): ("grand", 22, 3, 22, "match"), (9, "net_kg"): ("grand", 1258.5, 3, 1258.5, "match"), (13, "gross_kg"): ("section", 6, 2, None, "unknown"),
    }
    empty = ledger_sheets.assemble(sheet(spark, LEDGER).limit(0), "doc")
    assert [df.count() for df in empty] == [0, 0]


def test_ledger_numbers_never_guess_a_unit(spark):
    cases = [("12", "net_kg", None, None, "no_unit"), ("12 kg", "net_kg", None, 12.0, None), ("1,234.5", "net_kg", "t", 1234500.0, None), ("2 t", "net_kg", "kg", None, "unit_conflict"), ("1 kgs", "net_kg", "kg", 1.0, None), ("3-4", "quantity", None, None, "unclear"), ("2.5", "quantity", None, None, "not_a_count"), ("2 kg", "quantity", None, None, "not_a_count"), ("-1", "quantity", None, None, "out_of_range"), ("TBD", "quantity", None, None, "none"), ("5 箱", "package_count", None, 5.0, None), ("3 parsec", "length_mm", None, None, "unknown_unit"), (None, "quantity", None, None, "none")]
    df = spark.createDataFrame([c[:3] for c in cases], "raw string, field string, unit string").select(ledger_sheets.number(F.col("raw"), F.col("field"), F.col("unit")).alias("n"))
    assert [(r.n.value, r.n.reason) for r in df.collect()] == [c[3:] for c in cases]


def test_headers_in_two_languages(spark):
    cases = {"箱号 Case No": ["package_id"], "Net weight (kg)": ["net_kg"], "净重 / Gross weight": ["net_kg", "gross_kg"], "总毛重(吨)": ["gross_kg"], "Width per package mm": ["width_mm"], "L×W×H": ["dimensions"], "colour": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", ledger_sheets.header_fields(F.col("raw")).alias("f"))
    assert {r.raw: sorted(r.f) for r in df.collect()} == {k: sorted(v) for k, v in cases.items()}


def test_merged_cells_count_once(spark):
    lines = [
        ["Case No", "name", "qty", "gross kg", "箱数"], ["C1", "a", "1", "90", "1"], ["", "b", "2", "", ""], ["", "c", "3", "", ""], ["Subtotal", "", "6", "90", "1"],
        ["C2", "d", "4", "50", "2"], ["Subtotal", "", "4", "50"], ["", "e", "5", "", "7"], ["Total", "", "5", "1", "7"],
    ]
    cells = sheet(spark, lines)
    merges = spark.createDataFrame([("d", 2, 4, 4), ("d", 2, 4, 5), ("d", 2, 4, 1), ("d", 6, 8, 4), ("d", 8, 8, 5)], "doc string, first_row int, last_row int, col int")
    rows, totals = ledger_sheets.assemble(cells, "doc", merges=merges)
    got = {r.name: r for r in rows.collect()}
    assert got["a"].gross_kg == 90 and got["b"].gross_kg is None
    assert all(got[n].shared == {"gross_kg": 2, "package_count": 2, "package_id": 2} for n in "abc") and got["e"].shared == {}
    assert got["d"].gross_kg is None and got["d"].reasons == {"gross_kg": "merged_over_others"}
    assert {(r.row, r.field): (r.summed, r.status) for r in totals.collect()} == {
        (5, "quantity"): (6, "match"), (5, "gross_kg"): (90, "match"), (5, "package_count"): (1, "match"), (7, "quantity"): (4, "match"), (7, "gross_kg"): (None, "unknown"),
        (9, "quantity"): (5, "match"), (9, "gross_kg"): (None, "unknown"), (9, "package_count"): (7, "match"),
    }
    unmerged = ledger_sheets.assemble(cells, "doc")[1].where("row = 5 AND field = 'gross_kg'").first()
    assert (unmerged.summed, unmerged.status) == (None, "unknown")
