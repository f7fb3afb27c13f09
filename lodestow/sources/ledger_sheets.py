"""Sheets of a logistics ledger as rows and totals: the header, section and block that hold for a row are what was met before it, by running windows over a sheet."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import written

# The spellings of each field's header, in the two languages of the sheets.
HEADERS = {
    "container_id": ("集装箱号", "柜号", "container no", "container number", "container id", "ctn no"),
    "package_type": ("包装类型", "包装形式", "package type", "packing type"),
    "package_id": ("箱号", "包装号", "package id", "package no", "case no", "case number", "box no", "carton no"),
    "material_id": ("物料编号", "材料编号", "物料编码", "材料编码", "料号", "件号", "item no", "item code", "part no", "material id", "sku"),
    "name": ("name", "品名", "货物名称", "材料名称", "名称", "货物名称及规格", "品名及规格", "description", "item description", "commodity"),
    "spec": ("spec", "规格", "型号", "specification", "model"),
    "package_count": ("箱数", "包装数", "包装数量", "包装总箱数", "number of packages", "no of packages", "packages", "cases", "cartons", "package count"),
    "quantity": ("quantity", "qty", "件数", "总件数", "数量", "total quantity", "total pcs", "pcs", "货物件数"),
    "units_per_package": ("每箱件数", "每箱数量", "pcs per carton", "pcs per box", "quantity per package", "units per package"),
    "unit": ("单位", "unit", "uom", "unit of measure"),
    "length_mm": ("length", "长", "长度", "箱长", "package length", "item length", "length mm"),
    "width_mm": ("width", "宽", "宽度", "箱宽", "package width", "item width", "width mm"),
    "height_mm": ("height", "高", "高度", "箱高", "package height", "item height", "height mm"),
    "net_kg": ("net", "net weight", "n.w.", "净重", "net kg"),
    "gross_kg": ("gross", "gross weight", "g.w.", "毛重", "gross kg"),
    "dimensions": ("dimensions", "dimension", "尺寸", "长宽高", "l x w x h", "l*w*h", "l×w×h", "package dimensions", "箱外尺寸"),
}
# Units of length in mm and of weight in kg; units of a quantity and of a package; labels of totals; what stands for nothing.
LENGTHS = {"mm": 1.0, "毫米": 1.0, "cm": 10.0, "厘米": 10.0, "m": 1000.0, "米": 1000.0, "in": 25.4, "inch": 25.4, "inches": 25.4, "ft": 304.8}
WEIGHTS = {"kg": 1.0, "kgs": 1.0, "千克": 1.0, "公斤": 1.0, "g": 0.001, "t": 1000.0, "吨": 1000.0, "lb": 0.45359237, "lbs": 0.45359237}
PIECES = ("pcs", "pc", "ea", "件", "个", "套", "卷", "米", "m", "根", "支", "片", "块", "张", "roll", "rolls", "set", "sets", "pair", "pairs")
PACKAGES = ("箱", "木箱", "纸箱", "铁箱", "铁框", "铁架", "框", "扎", "捆", "袋", "卷", "包", "托", "托盘", "件", "个", "pcs", "pc", "ea", "packages", "cartons", "cases", "case", "pallet", "pallets", "bundles", "bundle", "bags", "bag", "crates", "crate")
TOTALS, GRAND = ("合计", "总计", "小计", "本页合计", "total", "subtotal", "grandtotal"), ("总计", "grandtotal")
NOTHING = ("UNSPECIFIED", "N/A", "NA", "TBD", "-", "—", "待定", "待填")
COUNTS, SIZES, MASSES = ("package_count", "quantity", "units_per_package"), ("length_mm", "width_mm", "height_mm"), ("net_kg", "gross_kg")
NUMBERS = (*COUNTS, *SIZES, *MASSES)
TEXTS = ("container_id", "package_type", "package_id", "material_id", "name", "spec", "unit")
MOST = 1e12
#: A list of headings is sent to all executors up to so many; a longer one is joined by a shuffle.
SENT_HEADINGS = 100_000
_CJK = "\\u4e00-\\u9fff"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[\\s_.,:()（）\\[\\]/\\\\#-]+", "")


def _words(units: dict[str, float] | tuple[str, ...]) -> str:
    return "|".join(sorted(units, key=len, reverse=True))


def header_fields(raw: Column) -> Column:
    """The fields that a cell may head: of the whole text, of its Chinese and of its other words, each as written, without units, and without words of scope."""
    known = F.map_from_arrays(*(F.array(*(F.lit(x) for x in xs)) for xs in zip(*sorted({w: f for f, ws in HEADERS.items() for w in (*(_squeeze(x) for x in ws), _squeeze(f))}.items()), strict=True)))
    latin = [u for u in {**LENGTHS, **WEIGHTS, "pcs": 1, "ea": 1} if u.isascii()]
    unit = f"(?<![a-z])({_words(tuple(latin))})(?![a-z])|{_words(tuple(u for u in {**LENGTHS, **WEIGHTS} if not u.isascii() and len(u) > 1))}|吨"
    scope = "(?i)per\\s*(package|box|carton|case|item|piece)|每箱|每件|单件|整行|总|total"

    def field(text: Column) -> Column:
        bare = lambda t: F.regexp_replace(F.replace(F.lower(t), F.lit("_"), F.lit(" ")), unit, "")
        return F.coalesce(*(F.try_element_at(known, _plain(t)) for t in (text, bare(text), bare(F.regexp_replace(text, scope, "")))))

    text = F.trim(raw)
    return F.array_compact(F.array_distinct(F.array(field(text), field(F.regexp_replace(text, f"[^{_CJK}]", "")), field(F.regexp_replace(text, f"[{_CJK}]+", " ")))))


def _squeeze(text: str) -> str:
    return re.sub(r"[\s_.,:()（）\[\]/\\#-]+", "", text.lower())


def stated_unit(raw: Column, units: dict[str, float]) -> Column:
    """The one unit that a header names; null for none or several."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(raw), F.lit(f"([a-z]+|[{_CJK}]+)"), F.lit(1)), lambda t: t.isin(*units)))
    return F.when(F.size(found) == 1, found[0])


def stated_scope(raw: Column) -> Column:
    """package, item or row, where a header says what its figure is of."""
    n = _plain(raw)
    package = n.isin("package", "箱", "每箱", "包装") | n.rlike("per(package|box|carton|case)|每箱|箱外|箱长|箱宽|箱高|package(length|width|height|dimensions)")
    item = n.isin("item", "单件", "每件") | n.rlike("per(item|piece)|单件|每件|item(length|width|height)")
    row = n.isin("row", "整行", "行合计") | n.rlike("rowtotal|整行|行合计|total(net|gross)|总净重|总毛重")
    return F.when(package, "package").when(item, "item").when(row, "row")


def read_figure(raw: Column) -> Column:
    """struct(value, suffix) of a cell: its number, null where it is none, and the word after it."""
    text = F.trim(raw)
    shape = f"^([+-]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?)\\s*([A-Za-z{_CJK}]*)$"
    value = F.when(text.rlike(shape), F.regexp_replace(F.regexp_extract(text, shape, 1), ",", "").try_cast("double"))
    return F.struct(value.alias("value"), F.nullif(F.lower(F.regexp_extract(text, shape, 2)), F.lit("")).alias("suffix"))


def number(raw: Column, field: Column, unit: Column, read: Column | None = None) -> Column:
    """struct(value, reason): a figure in its field's own unit. A unit is never inferred: without one, or against the header's, there is no value but a reason.

    ``read`` is the cell's ``read_figure`` where a column holds it: otherwise every condition reads the cell again.
    """
    text, read = F.trim(raw), read_figure(raw) if read is None else read
    value, suffix = read["value"], read["suffix"]
    table = lambda units: F.map_from_arrays(F.array(*(F.lit(u) for u in units)), F.array(*(F.lit(v) for v in units.values())))
    scale = lambda u: F.when(field.isin(*SIZES), F.try_element_at(table(LENGTHS), u)).otherwise(F.try_element_at(table(WEIGHTS), u))
    count = field.isin(*COUNTS)
    named = F.when(field == "package_count", suffix.isin(*PACKAGES)).otherwise(suffix.isin(*PIECES))
    use = F.coalesce(suffix, unit)
    scaled = F.round(value * scale(use), 8)
    # A function over a list keeps Spark from compiling all conditions into one method, too long for the JVM to optimise.
    said = F.coalesce(text, F.lit(""))
    nothing = F.exists(F.array(*(F.lit(w) for w in ("", *NOTHING))), lambda w: (w == said) | (w == F.upper(said)))
    reason = (
        F.when(nothing, "none")
        .when(value.isNull(), "unclear").when((value < 0) | (value > MOST), "out_of_range")
        .when(count & ((value != F.floor(value)) | (suffix.isNotNull() & ~named)), "not_a_count")
        .when(~count & suffix.isNotNull() & scale(suffix).isNull(), "unknown_unit")
        .when(~count & suffix.isNotNull() & unit.isNotNull() & (scale(suffix) != scale(unit)), "unit_conflict")
        .when(~count & scale(use).isNull(), "no_unit").when(~count & (scaled > MOST), "out_of_range")
    )
    return F.struct(F.when(reason.isNull(), F.when(count, value).otherwise(scaled)).alias("value"), reason.alias("reason"), F.when(reason.isNull() & count, suffix).alias("suffix"))


def _label(raw: Column) -> tuple[Column, Column]:
    """Is this the label of a total, of a grand total?"""
    cjk, other = F.regexp_replace(raw, f"[^{_CJK}]", ""), _plain(F.regexp_replace(raw, f"[{_CJK}]+", ""))
    some = (cjk != "") | (other != "")
    # No label has a digit: most first cells are read no further.
    total = ~raw.rlike("[0-9]") & some & ((cjk == "") | cjk.isin(*TOTALS)) & ((other == "") | other.isin(*TOTALS))
    grand = total & (cjk.isin(*GRAND) | other.isin(*GRAND)) & ((cjk == "") | cjk.isin("总计", "合计")) & ((other == "") | other.isin("total", "grandtotal"))
    return F.coalesce(total, F.lit(False)), F.coalesce(grand, F.lit(False))


def _headings(filled: DataFrame) -> DataFrame:
    """(raw, fields, unit, scope) of the distinct texts that name a field: each is read once, however many sheets have it."""
    # A figure heads nothing: what has no letters is not looked up, nor what has a digit but no Chinese: no header's name has digits.
    heads = F.col("raw").rlike(f"[{_CJK}]|^[^0-9]*[A-Za-z][A-Za-z][^0-9]*$")
    named = written(filled.where(heads).select("raw").distinct().withColumn("fields", header_fields(F.col("raw")))).where(F.size("fields") > 0)
    sized = F.col("fields")[0].isin(*SIZES, "dimensions")
    read = written(named.withColumns({"unit": F.when(sized, stated_unit(F.col("raw"), LENGTHS)).otherwise(stated_unit(F.col("raw"), WEIGHTS)), "scope": stated_scope(F.col("raw"))}))
    return F.broadcast(read) if read.count() <= SENT_HEADINGS else read


def _placed(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(lines, filled): each line's kind, header, block and section, its cells that name one field without doubt, and the cells that hold something."""
    filled = cells.where(F.trim("raw") != "").select(*keys, "row", "col", "raw")
    named = filled.join(_headings(filled), "raw", "left")
    one, several = F.when(F.size("fields") == 1, F.col("fields")[0]), F.coalesce(F.size("fields") > 1, F.lit(False))
    heads = F.collect_list(F.when(F.size("fields") == 1, F.struct("col", F.col("fields")[0].alias("field"), F.col("unit").alias("_unit"), F.col("scope").alias("_scope"))))
    lines = named.groupBy(*keys, "row").agg(F.collect_set(one).alias("fields"), F.bool_or(several).alias("conflict"), F.min_by("raw", "col").alias("first"), heads.alias("heads"))
    header = ((F.size("fields") >= 2) | ((F.size("fields") >= 1) & F.col("conflict"))) & F.arrays_overlap("fields", F.array(F.lit("name"), F.lit("package_id"), F.lit("material_id")))
    total, grand = _label(F.col("first"))
    lines = lines.select(*keys, "row", "first", F.when(header, F.col("heads")).alias("heads"), header.alias("header"), (total & ~header).alias("total"), (grand & ~header).alias("grand"))
    sheet = Window.partitionBy(*keys).orderBy("row")
    upto, before = sheet.rowsBetween(Window.unboundedPreceding, 0), sheet.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("header_no", F.sum(F.col("header").cast("int")).over(upto)).where("header_no > 0")
    ran = lambda c: F.coalesce(F.sum(F.col(c).cast("int")).over(before), F.lit(0))
    lines = lines.withColumns({"section": ran("total"), "_g": ran("grand")})
    # A header begins a new block only where a grand total has closed the one before it; else it goes on, on another page.
    return lines.withColumn("block", F.last(F.when(F.col("header"), F.col("_g")), ignorenulls=True).over(upto)).drop("_g"), filled


def _heads(lines: DataFrame, on: list[str]) -> DataFrame:
    """(keys, header_no, col, _k, field, targets, _unit, _scope, _twice): a row for each target of the columns that a header names without doubt, and whether the header has another column for it."""
    heads = lines.where("header").select(*on, "header_no", F.explode("heads").alias("h")).select(*on, "header_no", "h.*")
    targets = F.when(F.col("field") == "dimensions", F.array(*(F.lit(f) for f in SIZES))).otherwise(F.array("field"))
    each = heads.withColumn("targets", targets).select("*", F.posexplode("targets").alias("_k", "_to"))
    return each.withColumn("_twice", F.count("*").over(Window.partitionBy(*on, "header_no", "_to")) > 1)


def shared_cells(merges: DataFrame, heads: DataFrame, lines: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """(keys, row, field, anchor, whole): the rows that a merged cell covers, and whether all of them are rows of the ledger.

    merges(keys, first_row, last_row, col); the cell's figure stands in its first row. A cell over one row is no group.
    """
    spans = merges.where("last_row > first_row").withColumn("row", F.explode(F.sequence("first_row", "last_row"))).join(lines.select(*on, F.col("row").alias("first_row"), "header_no"), [*on, "first_row"])
    fields = spans.join(heads.select(*on, "header_no", "col", F.col("_to").alias("field")), [*on, "header_no", "col"])
    met = fields.join(rows.select(*on, "row", F.lit(True).alias("_here")), [*on, "row"], "left")
    whole = met.groupBy(*on, "field", "first_row").agg((F.count("_here") == F.count("*")).alias("whole"))
    return met.join(whole, [*on, "field", "first_row"]).select(*on, "row", "field", F.col("first_row").alias("anchor"), "whole")


def _read_lines(cells: DataFrame, lines: DataFrame, heads: DataFrame, on: list[str]) -> DataFrame:
    """(keys, row, the fields, dimension_scope, weight_scope, reasons) of lines, from their cells under the columns of heads."""
    body = cells.join(lines.select(*on, "row", "header_no"), [*on, "row"]).join(heads, [*on, "header_no", "col"])
    pieces = F.split("raw", "\\s*[x×*]\\s*")
    part = F.when(F.col("field") == "dimensions", F.when(F.size(pieces) == 3, F.get(pieces, F.col("_k"))).otherwise("?")).otherwise(F.col("raw"))
    each = body.withColumn("_raw", part).withColumn("field", F.col("_to"))
    numeric = F.col("field").isin(*NUMBERS)
    sure = numeric & ~F.col("_twice")
    each = each.withColumn("_read", F.when(sure, read_figure(F.col("_raw")))).withColumn("_n", F.when(sure, number(F.col("_raw"), F.col("field"), F.col("_unit"), F.col("_read"))))
    text = F.when(~numeric & ~F.col("_twice"), F.trim("raw"))
    reason = F.when(F.col("_twice"), "several_columns").otherwise(F.nullif(F.col("_n.reason"), F.lit("none")))
    values = each.select(*on, "row", "field", F.col("_n.value").alias("v"), F.col("_n.suffix").alias("suffix"), text.alias("t"), reason.alias("reason"), "_scope")
    at = lambda name, c: F.max(F.when(F.col("field") == name, F.col(c)))
    scope = lambda fields: F.collect_set(F.when(F.col("field").isin(*fields), F.col("_scope")))
    wide = values.groupBy(*on, "row").agg(
        *(at(f, "v").alias(f) for f in NUMBERS), *(at(f, "t").alias(f) for f in TEXTS), at("quantity", "suffix").alias("_pieces"), at("package_count", "suffix").alias("_packages"),
        scope(SIZES).alias("_ds"), scope(MASSES).alias("_ws"), F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.struct("field", "reason"))))).alias("reasons"),
    )

    # A unit beside a figure is that of its column's neighbour; against it, neither counts.
    clash = lambda suffix, column: F.coalesce(_plain(F.col(suffix)) != _plain(F.col(column)), F.lit(False))
    for suffix, figure, column in (("_pieces", "quantity", "unit"), ("_packages", "package_count", "package_type")):
        bad = clash(suffix, column)
        said = F.when(bad, F.map_concat("reasons", F.create_map(F.lit(f"{figure}:unit"), F.lit("unit_conflict")))).otherwise(F.col("reasons"))
        wide = wide.withColumns({figure: F.when(~bad, F.col(figure)), column: F.when(~bad, F.coalesce(column, suffix)), "reasons": said})
    only = lambda c: F.when(F.size(c) == 1, F.col(c)[0])
    return wide.withColumns({"dimension_scope": only("_ds"), "weight_scope": only("_ws")}).drop("_pieces", "_packages", "_ds", "_ws")


def assemble(cells: DataFrame, *keys: str, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of sheets as cells(keys, row, col, raw) and, if given, merges(keys, first_row, last_row, col) of cells that cover several rows.

    rows(keys, row, block, section, the fields, dimension_scope, weight_scope, reasons): a line under a header that is no total. A field without a sure
    value is null and reasons says why: two columns for one field, no unit, a unit against the header's, no clear number. totals(keys, row, label, kind,
    field, stated, n_rows, summed, status): each figure of a total against the rows it closes: those of its section, or of its block for a grand total; status is
    match, mismatch, or unknown where a row lacks a value. A merged cell's figure belongs to all rows that it covers and counts once: rows has them in
    column shared, (field, anchor), so that no one spreads or repeats it; over lines that are no rows it has no value, nor has a total that closes a part of its rows. Lines before a header are left out; a blank sheet has no rows. A sheet is bounded (the format has
    a million lines); its windows are one task's, and sheets are dealt over all.
    """
    on = list(keys)
    lines, written_cells = _placed(cells, on)
    # A row a line and a row a header's column: kept, as each is met several times below.
    lines = written(lines)
    heads = written(_heads(lines, on))
    lines = lines.drop("heads")
    # A total's line is read for its figures, every other line as a row: none twice.
    plain, closing = lines.where("NOT header AND NOT total"), lines.where("total")
    placed = _read_lines(written_cells, plain, heads, on).join(plain.select(*on, "row", "block", "section"), [*on, "row"])
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in ("name", "package_id", "material_id", *NUMBERS)))
    rows = placed.where(some)
    if merges is None:
        rows, members = rows.withColumn("shared", F.expr("cast(map() AS map<string, int>)")), None
    else:
        members = shared_cells(merges, heads, lines, rows, on)
        told = members.groupBy(*on, "row").agg(F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("whole"), F.struct("field", "anchor"))))).alias("shared"), F.collect_set(F.when(~F.col("whole"), F.col("field"))).alias("_torn"))
        torn = lambda f: F.coalesce(F.array_contains("_torn", f), F.lit(False))
        rows = rows.join(told, [*on, "row"], "left")
        said = F.map_from_arrays("_torn", F.transform("_torn", lambda _: F.lit("merged_over_others")))
        rows = rows.withColumns({**{f: F.when(~torn(f), F.col(f)) for f in (*NUMBERS, *TEXTS)}, "shared": F.coalesce("shared", F.expr("cast(map() AS map<string, int>)")), "reasons": F.when(F.size("_torn") > 0, F.map_concat(F.map_filter("reasons", lambda k, _: ~F.array_contains("_torn", k)), said)).otherwise(F.col("reasons"))}).drop("_torn")

    stack = ", ".join(f"'{f}', {f}" for f in NUMBERS)
    stated = closing.select(*on, "row", "block", "section", "grand", F.trim("first").alias("label")).join(_read_lines(written_cells, closing, heads, on).select(*on, "row", F.expr(f"stack({len(NUMBERS)}, {stack}) AS (field, stated)")), [*on, "row"]).where("stated IS NOT NULL")
    figures = rows.select(*on, "row", "block", "section", F.expr(f"stack({len(NUMBERS)}, {stack}) AS (field, v)"))
    if members is not None:
        # What stands in the first row is counted there; the others add nothing, unless the total closes another part of the rows.
        anchors = rows.select(*on, F.col("row").alias("anchor"), F.col("block").alias("_b"), F.col("section").alias("_s"))
        rest = members.where("whole AND row <> anchor").join(anchors, [*on, "anchor"]).select(*on, "row", "field", "_b", "_s")
        figures = figures.join(rest, [*on, "row", "field"], "left").withColumn("v", F.when((F.col("_b") == F.col("block")) & (F.col("_s") == F.col("section")) & F.col("v").isNull(), 0.0).otherwise(F.col("v"))).drop("_b", "_s")
    sums = figures.groupBy(*on, "block", "section", "field").agg(F.count("*").alias("n"), F.count("v").alias("known"), F.sum("v").alias("s"))
    # A grand total closes all sections of its block so far, its own included.
    order = Window.partitionBy(*on, "block", "field").orderBy("section")
    sums = sums.withColumns({f"all_{c}": F.sum(c).over(order) for c in ("n", "known", "s")})
    sums = sums.withColumnsRenamed({"block": "_b", "section": "_s", "field": "_f"})
    closes = (F.col("_b") == F.col("block")) & (F.col("_f") == F.col("field")) & ((F.col("_s") == F.col("section")) | (F.col("grand") & (F.col("_s") < F.col("section"))))
    for k in on:
        sums = sums.withColumnRenamed(k, f"_on_{k}")
        closes &= F.col(f"_on_{k}") == F.col(k)
    pick = lambda c: F.when(F.col("grand"), F.max_by(f"all_{c}", "_s")).otherwise(F.max(c))
    both = stated.join(sums, closes, "left").groupBy(*on, "row", "label", "grand", "field", "stated").agg(*(F.coalesce(pick(c), F.lit(0)).alias(c) for c in ("n", "known", "s")))
    summed = F.when(F.col("known") == F.col("n"), F.round("s", 8))
    status = F.when(summed.isNull(), "unknown").when(F.abs(summed - F.col("stated")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("stated")), "match").otherwise("mismatch")
    totals = both.select(*on, "row", "label", F.when(F.col("grand"), "grand").otherwise("section").alias("kind"), "field", "stated", F.col("n").cast("bigint").alias("n_rows"), summed.alias("summed"), status.alias("status"))
    return rows, totals
