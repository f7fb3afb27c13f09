"""Gates over dirty rows and rules of the logistics ledger, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import plain_double
from ..operators import cargo as cargo_ops
from ..operators import gates, ledger
from . import clause_sql
from .tables import SQL_CARGO, SQL_CONTAINERS, cargo, containers

# --- rows as people write them: cells of text, some missing, some no number


def _cells(spark: SparkSession, d: str) -> DataFrame:
    k, m = (F.col("part_no") * 7 + F.col("row_id") * 3) % 20, (F.col("part_no") + F.col("row_id")) % 9
    text = lambda c: F.col(c).cast("string")
    weight = F.when(k == 1, "abc").when(k == 2, "-3").when(k == 3, "0").when(k == 4, " ").when(k == 18, "70f").when(k != 0, text("weight_kg"))
    total = F.when(m == 0, "-5").when(m == 1, "0").when(m == 2, (F.col("weight_kg") * F.col("qty")).cast("string"))
    length = F.when(k == 5, "0").when(k == 7, "x").when(k == 19, "900d").when(k != 6, text("length_mm"))
    width = F.when(k == 8, "-1").when(k != 6, text("width_mm"))
    height = F.when(k == 9, "").otherwise((F.col("height_mm") * 2 + 100).cast("string"))
    quantity = F.when(k == 10, "2.7").when(k == 11, "abc").when(k == 12, "-3").when(k == 13, "0").when(k == 15, "1e3").when(k == 16, "5d").when(k == 17, "12f").when(k != 14, text("qty"))
    name = F.concat(F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.col("part_no") % len(_NAMES) + 1).cast("int")), F.lit(" "), F.col("name"))
    columns = {"weight": weight, "total": total, "length": length, "width": width, "height": height, "quantity": quantity, "label": name}
    return cargo(spark, d).select("shipment_id", "row_id", *(c.alias(n) for n, c in columns.items()))


_NAMES = ("A-frame stillage", "steel rack for glass panels", "curtain wall panel", "Stillages", "delivery stand", "rack", "transport racks carrying units", "周转架", "框架玻璃板块", "returnable steel frame", "Glass stillage", "stillage unit", "玻璃周转架", "Unitised panel on A-frame", "A frames to carry large cladding panels,", "glazing unit rack", "steel racks, glass", "holding frame for mullions: transport stand")
_SQL_CELLS = f"""WITH {SQL_CARGO}, k AS (SELECT *, (part_no * 7 + row_id * 3) % 20 AS k, (part_no + row_id) % 9 AS m FROM cargo), cells AS (SELECT shipment_id, row_id,
  CASE k WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '-3' WHEN 3 THEN '0' WHEN 4 THEN ' ' WHEN 18 THEN '70f' ELSE weight_kg::VARCHAR END AS weight,
  CASE m WHEN 0 THEN '-5' WHEN 1 THEN '0' WHEN 2 THEN (weight_kg * qty)::VARCHAR END AS total,
  CASE k WHEN 5 THEN '0' WHEN 7 THEN 'x' WHEN 19 THEN '900d' WHEN 6 THEN NULL ELSE length_mm::VARCHAR END AS length, CASE k WHEN 8 THEN '-1' WHEN 6 THEN NULL ELSE width_mm::VARCHAR END AS width,
  CASE k WHEN 9 THEN '' ELSE (height_mm * 2 + 100)::VARCHAR END AS height,
  CASE k WHEN 10 THEN '2.7' WHEN 11 THEN 'abc' WHEN 12 THEN '-3' WHEN 13 THEN '0' WHEN 15 THEN '1e3' WHEN 16 THEN '5d' WHEN 17 THEN '12f' WHEN 14 THEN NULL ELSE qty::VARCHAR END AS quantity,
  ([{", ".join(f"'{x}'" for x in _NAMES)}])[part_no % {len(_NAMES)} + 1] || ' ' || name AS label FROM k)"""


def gate_missing_weight(spark: SparkSession, d: str) -> DataFrame:
    return gates.missing_weight(_cells(spark, d), "weight", "total").select("shipment_id", "row_id", "weight", "total")


def gate_missing_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return gates.missing_dimensions(_cells(spark, d), "length", "width", "height").select("shipment_id", "row_id", "missing")


def gate_invalid_quantity(spark: SparkSession, d: str) -> DataFrame:
    return gates.invalid_quantity(_cells(spark, d), "quantity").select("shipment_id", "row_id", "quantity")


def gate_packaging(spark: SparkSession, d: str) -> DataFrame:
    return gates.packaging(_cells(spark, d), "label").select("shipment_id", "row_id", "label")


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    """All gates of a shipment into 20-foot containers, one after another."""
    rows, edges = _cells(spark, d), ("length", "width", "height")
    read = gates.read(rows, "weight", "total", *edges, "quantity").withColumn("missing", gates.lacking(*edges))
    sizes, none = [F.col(f"_{c}_number") for c in edges], F.lit("")
    sized = F.sort_array(F.array(*sizes))
    over = (sized[0] > F.col("inner")[0] + 1e-6) | (sized[1] > F.col("inner")[1] + 1e-6) | (sized[2] > F.col("inner")[2] + 1e-6)
    over = F.least(*(F.coalesce(c, F.lit(0.0)) > 0 for c in sizes)) & over
    inner = F.broadcast(cargo_ops.inner_edges(containers(spark), "20GP"))  # one row
    # Answers go along, no cell is shuffled but the label, whose names are few and need no sort. Reasons are made after that: a method of over 8,000 bytes is not compiled.
    gated = read.crossJoin(inner).select("shipment_id", "row_id", "label", "missing", gates.unweighed("weight", "total").alias("unweighed"), gates.uncounted("quantity").alias("uncounted"), over.alias("over"))
    names = gates.packaging_names(rows, "label").select("label", F.lit(True).alias("equipment"))
    found = {
        "missing_weight": (F.col("unweighed"), none),
        "missing_dimensions": (F.col("missing") != "", F.col("missing")),
        "invalid_quantity": (F.col("uncounted"), none),
        "oversize_for_container": (F.col("over"), none),
        "packaging_not_cargo": (F.col("equipment"), none),
    }
    each = gated.join(names.hint("shuffle_hash"), "label", "left").select("shipment_id", "row_id", F.explode(gates.reasons(found)).alias("g")).where("g IS NOT NULL")
    return each.groupBy("shipment_id", "row_id", "g.reason", "g.detail").agg(F.count("*").alias("n"))


# --- ledger rows: a shipment is a document, its rows state packages


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two in three shipments; the third kind has one package label each and agrees with itself."""
    p, r, calm = F.col("part_no"), F.col("row_id"), F.col("shipment_id") % 3 == 0
    scope = lambda k: F.when(calm | (k == 0) | (k == 4), "package").when(k == 1, "item").when(k == 2, "row")
    unit = F.when(p % 19 != 0, F.element_at(F.array(*(F.lit(u) for u in _UNITS)), (p % len(_UNITS) + 1).cast("int")))
    columns = {
        "name": F.when(p % 29 != 0, F.col("name")),
        "quantity": F.when(p % 17 != 0, F.when(p % 41 == 0, 0).otherwise(F.col("qty"))),
        "unit": unit,
        "package_id": F.when(r % 4 != 3, F.concat(F.lit("B"), F.when(calm, 1).otherwise(r % 2).cast("string"))),
        "container_id": F.when(calm, "C1").when(F.col("shipment_id") % 5 != 0, F.when(r % 3 == 0, None).otherwise("C1")).otherwise("C2"),
        "package_count": F.when(calm, 2).when(p % 13 != 0, F.col("supplier_id") % 4 + 1).cast("bigint"),
        "units_per_package": F.when(p % 11 == 0, F.col("qty")),
        "length_mm": F.when(calm, 1200).otherwise(F.col("length_mm")).cast("bigint"),
        "width_mm": F.when(calm, 800).otherwise(F.col("width_mm")).cast("bigint"),
        "height_mm": F.when(calm, 900).otherwise(F.col("height_mm")).cast("bigint"),
        "net_kg": F.when(calm, 100).when(p % 31 != 0, F.col("weight_kg")).cast("bigint"),
        "gross_kg": F.when(calm, 120).otherwise(F.col("weight_kg") + F.when(p % 23 == 0, -1).otherwise(5)).cast("bigint"),
        "weight_scope": scope(p % 5),
        "dimension_scope": F.when(calm | (p % 7 != 0), "package"),
    }
    return cargo(spark, d).select("shipment_id", "row_id", *(c.alias(n) for n, c in columns.items()))


_UNITS = ("pcs", "EA", "件", "m2", "Pc")
_SQL_LEDGER = f"""WITH {SQL_CARGO}, ledger AS (SELECT shipment_id, row_id, CASE WHEN part_no % 29 <> 0 THEN name END AS name, CASE WHEN part_no % 17 = 0 THEN NULL WHEN part_no % 41 = 0 THEN 0 ELSE qty END AS quantity,
  CASE WHEN part_no % 19 = 0 THEN NULL WHEN lower(([{", ".join(f"'{u}'" for u in _UNITS)}])[part_no % {len(_UNITS)} + 1]) IN ('pc', 'pcs', 'ea', '件', '个') THEN 'pcs' ELSE ([{", ".join(f"'{u}'" for u in _UNITS)}])[part_no % {len(_UNITS)} + 1] END AS unit,
  CASE WHEN row_id % 4 = 3 THEN NULL WHEN shipment_id % 3 = 0 THEN 'B1' ELSE 'B' || (row_id % 2) END AS package_id,
  CASE WHEN shipment_id % 3 = 0 THEN 'C1' WHEN shipment_id % 5 = 0 THEN 'C2' WHEN row_id % 3 = 0 THEN NULL ELSE 'C1' END AS container_id,
  CASE WHEN shipment_id % 3 = 0 THEN 2 WHEN part_no % 13 <> 0 THEN supplier_id % 4 + 1 END AS package_count, CASE WHEN part_no % 11 = 0 THEN qty END AS units_per_package,
  CASE WHEN shipment_id % 3 = 0 THEN 1200 ELSE length_mm END AS length_mm, CASE WHEN shipment_id % 3 = 0 THEN 800 ELSE width_mm END AS width_mm, CASE WHEN shipment_id % 3 = 0 THEN 900 ELSE height_mm END AS height_mm,
  CASE WHEN shipment_id % 3 = 0 THEN 100 WHEN part_no % 31 <> 0 THEN weight_kg END AS net_kg, CASE WHEN shipment_id % 3 = 0 THEN 120 WHEN part_no % 23 = 0 THEN weight_kg - 1 ELSE weight_kg + 5 END AS gross_kg,
  CASE WHEN shipment_id % 3 = 0 OR part_no % 5 IN (0, 4) THEN 'package' WHEN part_no % 5 = 1 THEN 'item' WHEN part_no % 5 = 2 THEN 'row' END AS weight_scope,
  CASE WHEN shipment_id % 3 = 0 OR part_no % 7 <> 0 THEN 'package' END AS dimension_scope FROM cargo),
  totals AS (SELECT *, net_kg * f AS net_total, gross_kg * f AS gross_total FROM (SELECT *, CASE weight_scope WHEN 'package' THEN package_count WHEN 'item' THEN quantity WHEN 'row' THEN 1 END AS f FROM ledger)),
  labels AS (SELECT shipment_id, package_id, count(*) AS n_rows, count(DISTINCT coalesce(container_id, '?')) AS n_containers, count(container_id) > 0 AND count(container_id) < count(*) AS ambiguous FROM ledger WHERE package_id IS NOT NULL GROUP BY 1, 2),
  packages AS (SELECT shipment_id, min(row_id) AS row_id, count(*) AS n_rows, arg_min(net_total, row_id) FILTER (net_total IS NOT NULL) AS any_net, first(net_total ORDER BY row_id) AS net, first(gross_total ORDER BY row_id) AS gross, first(package_count ORDER BY row_id) AS pc,
      count(*) > 1 AND (bool_or(coalesce(ambiguous, FALSE)) OR count(*) FILTER (weight_scope = 'package') < count(*) OR count(*) FILTER (dimension_scope = 'package') < count(*) OR count(package_count) = 0
        OR count(DISTINCT coalesce(package_count, -1)) > 1 OR count(DISTINCT length_mm) > 1 OR count(DISTINCT width_mm) > 1 OR count(DISTINCT height_mm) > 1 OR count(DISTINCT coalesce(net_kg, -1)) > 1 OR count(DISTINCT gross_kg) > 1) AS conflict
    FROM (SELECT t.*, l.ambiguous FROM totals t LEFT JOIN labels l ON t.shipment_id = l.shipment_id AND t.package_id = l.package_id)
    GROUP BY shipment_id, package_id, CASE WHEN ambiguous THEN '?' ELSE coalesce(container_id, '') END, CASE WHEN package_id IS NULL THEN row_id END)"""


def ledger_row_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d)
    return rows.select("shipment_id", "row_id", ledger.row_total("net_kg").cast("double").alias("net_total"), ledger.row_total("gross_kg").cast("double").alias("gross_total"))


def ledger_units(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.quantities_by_unit(_ledger(spark, d), "shipment_id")
    return found.select("shipment_id", F.coalesce("unit", F.lit("UNSPECIFIED")).alias("unit"), F.col("quantity").cast("double").alias("quantity"))


def package_identity(spark: SparkSession, d: str) -> DataFrame:
    return ledger.package_labels(_ledger(spark, d), "shipment_id")


def ledger_package_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each document: facts of a package once, and unknown as soon as one package's are."""
    facts = ledger.package_facts(_ledger(spark, d), "shipment_id")
    sums = (ledger.poisoned_sum(F.col(c)).cast("double").alias(f"sum_{c}") for c in ("package_count", "net_kg", "gross_kg"))
    return facts.groupBy("shipment_id").agg(F.count("*").alias("n_packages"), F.sum("n_rows").alias("n_rows"), F.count_if("conflict").alias("n_conflicts"), *sums)


def ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """Issues of all documents by severity, code and field."""
    return ledger.ledger_issues(_ledger(spark, d)).groupBy("severity", "code", "field").agg(F.count("*").alias("n"))


def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each document its errors and warnings, and whether it is ready: no error, all scopes of packages, all facts above 0."""
    positive = F.lit(True)
    for f in ("package_count", "gross_kg", "length_mm", "width_mm", "height_mm"):
        positive &= F.coalesce(F.col(f) > 0, F.lit(False))
    complete = F.coalesce((F.col("weight_scope") == "package") & (F.col("dimension_scope") == "package"), F.lit(False)) & positive
    counts = ledger.issue_counts(_ledger(spark, d).withColumn("incomplete", (~complete).cast("bigint")), "shipment_id", "incomplete")
    # Rows of no document are no document's issues.
    errors, warnings = (F.when(F.col("shipment_id").isNotNull(), F.col(c)).otherwise(0).alias(c) for c in ("errors", "warnings"))
    return counts.select("shipment_id", "n_rows", errors, warnings, "incomplete").select("shipment_id", "n_rows", "errors", "warnings", ((F.col("errors") == 0) & (F.col("incomplete") == 0)).alias("ready"))


def ledger_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two ledgers of suppliers by material id: it must be unique on both sides to be compared."""
    rows = cargo(spark, d).select(F.when(F.col("part_no") % 10 != 0, F.concat_ws("-", F.col("part_no").cast("string"), (F.col("shipment_id") % 7).cast("string"))).alias("material_id"), "shipment_id", "name", "category", F.col("qty").alias("quantity"))
    sides = [rows.where(F.col("shipment_id") % 4 == k) for k in (0, 1)]
    return ledger.compare_by_id(*sides, "material_id", ["name", "category", "quantity"])


QUERIES = {
    f.__name__: f
    for f in (
        gate_missing_weight, gate_missing_dimensions, gate_invalid_quantity, gate_packaging, gate_rows, ledger_row_totals, ledger_units, package_identity, ledger_package_totals, ledger_audit,
        ledger_summary, ledger_compare,
    )
}

_NUM = lambda c: f"TRY_CAST({c} AS DOUBLE)"
_BAD_WEIGHT = " OR ".join(f"(trim(coalesce({c}, '')) <> '' AND coalesce({_NUM(c)} < 0, TRUE))" for c in ("weight", "total"))
_GOOD_WEIGHT = " OR ".join(f"coalesce({_NUM(c)} > 0, FALSE)" for c in ("weight", "total"))
_LACKS = ", ".join(f"CASE WHEN NOT coalesce({_NUM(c)} > 0, FALSE) THEN '{c}' END" for c in ("length", "width", "height"))
_BAD_QUANTITY = f"trim(coalesce(quantity, '')) <> '' AND NOT coalesce({_NUM('quantity')} >= 1 AND {_NUM('quantity')} = floor({_NUM('quantity')}), FALSE)"
_PACKAGING_SQL = clause_sql.packaging("cells", "shipment_id, row_id, label", "label")
_ISSUES = """, issues AS (SELECT shipment_id, 'warning' AS severity, 'missing_name' AS code, 'name' AS field FROM ledger WHERE name IS NULL
  UNION ALL SELECT shipment_id, 'warning', 'missing_quantity', 'quantity' FROM ledger WHERE quantity IS NULL UNION ALL SELECT shipment_id, 'warning', 'missing_package_count', 'package_count' FROM ledger WHERE package_count IS NULL
  UNION ALL SELECT shipment_id, 'warning', 'zero_value', 'quantity' FROM ledger WHERE quantity = 0 UNION ALL SELECT shipment_id, 'error', 'quantity_mismatch', 'quantity' FROM ledger WHERE quantity <> package_count * units_per_package
  UNION ALL SELECT shipment_id, 'error', 'gross_below_net', 'gross_kg' FROM ledger WHERE gross_kg < net_kg UNION ALL SELECT shipment_id, 'error', 'unknown_scope', 'dimension_scope' FROM ledger WHERE dimension_scope IS NULL
  UNION ALL SELECT shipment_id, 'error', 'unknown_scope', 'weight_scope' FROM ledger WHERE weight_scope IS NULL UNION ALL SELECT shipment_id, 'error', 'package_group_conflict', 'package_id' FROM packages WHERE conflict
  UNION ALL SELECT shipment_id, 'warning', 'mixed_quantity_units', 'unit' FROM ledger GROUP BY 1 HAVING count(DISTINCT coalesce(unit, '?')) > 1 UNION ALL SELECT shipment_id, 'warning', 'unknown_quantity_unit', 'unit' FROM ledger GROUP BY 1 HAVING count(unit) < count(*))"""
_SUM = lambda c, name: f"CASE WHEN count({c}) = count(*) THEN sum({c})::DOUBLE END AS {name}"
SQL = {
    "gate_missing_weight": f"{_SQL_CELLS} SELECT shipment_id, row_id, weight, total FROM cells WHERE {_BAD_WEIGHT} OR NOT ({_GOOD_WEIGHT})",
    "gate_missing_dimensions": f"{_SQL_CELLS} SELECT * FROM (SELECT shipment_id, row_id, concat_ws(',', {_LACKS}) AS missing FROM cells) WHERE missing <> ''",
    "gate_invalid_quantity": f"{_SQL_CELLS} SELECT shipment_id, row_id, quantity FROM cells WHERE {_BAD_QUANTITY}",
    "gate_packaging": f"{_SQL_CELLS} {_PACKAGING_SQL}",
    "gate_rows": f"""{_SQL_CELLS}, {SQL_CONTAINERS}, found AS (SELECT shipment_id, row_id, 'missing_weight' AS reason, '' AS detail FROM cells WHERE {_BAD_WEIGHT} OR NOT ({_GOOD_WEIGHT})
      UNION ALL SELECT shipment_id, row_id, 'missing_dimensions', missing FROM (SELECT shipment_id, row_id, concat_ws(',', {_LACKS}) AS missing FROM cells) WHERE missing <> ''
      UNION ALL SELECT shipment_id, row_id, 'invalid_quantity', '' FROM cells WHERE {_BAD_QUANTITY} UNION ALL SELECT shipment_id, row_id, 'packaging_not_cargo', '' FROM ({_PACKAGING_SQL})
      UNION ALL SELECT shipment_id, row_id, 'oversize_for_container', '' FROM (SELECT shipment_id, row_id, list_sort([{_NUM('length')}, {_NUM('width')}, {_NUM('height')}]) AS e FROM cells WHERE {_NUM('length')} > 0 AND {_NUM('width')} > 0 AND {_NUM('height')} > 0) WHERE e[1] > 2352 OR e[2] > 2385 OR e[3] > 5898)
      SELECT shipment_id, row_id, reason, detail, count(*) AS n FROM found GROUP BY 1, 2, 3, 4""",
    "ledger_row_totals": f"{_SQL_LEDGER} SELECT shipment_id, row_id, net_total::DOUBLE AS net_total, gross_total::DOUBLE AS gross_total FROM totals",
    "ledger_units": f"{_SQL_LEDGER} SELECT shipment_id, coalesce(unit, 'UNSPECIFIED') AS unit, {_SUM('quantity', 'quantity')} FROM ledger GROUP BY shipment_id, coalesce(unit, 'UNSPECIFIED')",
    "package_identity": f"{_SQL_LEDGER} SELECT * FROM labels",
    "ledger_package_totals": f"""{_SQL_LEDGER}, sure AS (SELECT *, CASE WHEN NOT conflict THEN pc END AS p, CASE WHEN NOT conflict THEN net END AS n, CASE WHEN NOT conflict THEN gross END AS g FROM packages)
      SELECT shipment_id, count(*) AS n_packages, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (conflict) AS n_conflicts, {_SUM('p', 'sum_package_count')}, {_SUM('n', 'sum_net_kg')}, {_SUM('g', 'sum_gross_kg')} FROM sure GROUP BY 1""",
    "ledger_audit": f"{_SQL_LEDGER}{_ISSUES} SELECT severity, code, field, count(*) AS n FROM issues GROUP BY 1, 2, 3",
    "ledger_summary": f"""{_SQL_LEDGER}{_ISSUES}, i AS (SELECT shipment_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1),
      r AS (SELECT shipment_id, count(*) AS n_rows, count(*) FILTER (coalesce(weight_scope = 'package' AND dimension_scope = 'package' AND package_count > 0 AND gross_kg > 0 AND length_mm > 0 AND width_mm > 0 AND height_mm > 0, FALSE)) AS complete FROM ledger GROUP BY 1)
      SELECT shipment_id, n_rows, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AND complete = n_rows AS ready FROM r LEFT JOIN i USING (shipment_id)""",
    "ledger_compare": f"""WITH {SQL_CARGO}, r AS (SELECT part_no || '-' || (shipment_id % 7) AS material_id, shipment_id % 4 AS side, name, category, qty FROM cargo WHERE part_no % 10 <> 0), g AS (SELECT side, material_id, count(*) AS n, first(name) AS name, first(category) AS category, first(qty) AS qty FROM r WHERE side < 2 GROUP BY 1, 2),
      j AS (SELECT coalesce(a.material_id, b.material_id) AS material_id, a.n AS na, b.n AS nb, concat_ws(',', CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.category <> b.category THEN 'category' END, CASE WHEN a.qty <> b.qty THEN 'quantity' END) AS differs FROM (SELECT * FROM g WHERE side = 0) a FULL JOIN (SELECT * FROM g WHERE side = 1) b ON a.material_id = b.material_id)
      SELECT material_id, status, CASE WHEN status = 'different' THEN differs ELSE '' END AS differs FROM (SELECT *, CASE WHEN na > 1 OR nb > 1 THEN 'ambiguous_duplicate' WHEN nb IS NULL THEN 'only_current' WHEN na IS NULL THEN 'only_comparison' WHEN differs <> '' THEN 'different' ELSE 'same' END AS status FROM j)""",
}
