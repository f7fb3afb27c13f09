"""Ledger sheets made of orders, read back as rows and totals, each with the SQL that states the same figures without any sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import ledger_sheets
from .tables import table

_HEADS = {0: ("Case No", "品名 / Description", "Qty", "Net weight kg"), 1: ("箱号", "品名", "数量", "净重(lb)")}


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for twelve orders, in two blocks: a header, each order's lines and subtotal, a grand total. Some quantities are open, some subtotals wrong."""
    line = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 12).alias("doc"), (F.col("l_orderkey") % 2).cast("int").alias("half"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_partkey") % 50 + 1).alias("net"))
    text = lambda c: F.col(c).cast("string")
    qty = F.when(F.col("l_partkey") % 23 == 0, "TBD").when(F.col("l_partkey") % 3 == 0, F.concat(text("q"), F.lit(" pcs"))).otherwise(text("q"))
    data = line.select("doc", "half", F.col("l_orderkey").alias("o"), F.lit(1).alias("s"), "l_linenumber", "l_partkey", "l_suppkey", F.array(F.concat(F.lit("C"), text("l_partkey")), F.concat(F.lit("Part "), text("l_suppkey")), qty, text("net")).alias("cells"))
    total = lambda name, qty: F.array(F.lit(name), F.lit(""), qty.cast("string"), F.sum("net").cast("string")).alias("cells")
    none = [F.lit(0).alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    subtotal = line.groupBy("doc", "half", F.col("l_orderkey").alias("o")).agg(total("Subtotal", F.sum("q") + F.when(F.col("o") % 5 == 0, 1).otherwise(0))).select("doc", "half", "o", F.lit(2).alias("s"), *none, "cells")
    grand = line.groupBy("doc", "half").agg(total("总计", F.sum("q"))).select("doc", "half", F.lit(1 << 60).alias("o"), F.lit(3).alias("s"), *none, "cells")
    head = line.select("doc", "half").distinct().select("doc", "half", F.lit(-1).alias("o"), F.lit(0).alias("s"), *none, F.when(F.col("half") == 0, F.array(*map(F.lit, _HEADS[0]))).otherwise(F.array(*map(F.lit, _HEADS[1]))).alias("cells"))
    rows = data.union(subtotal).union(grand).union(head)
    order = Window.partitionBy("doc").orderBy("half", "o", "s", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumn("row", F.row_number().over(order)).select("doc", "row", F.posexplode("cells").alias("col", "raw"))


def ledger_sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of each sheet and block the rows read, those without a quantity, and what they add up to."""
    rows, _ = ledger_sheets.assemble(_sheets(spark, d), "doc")
    return rows.groupBy("doc", "block").agg(F.count("*").alias("n_rows"), F.count_if(F.col("quantity").isNull()).alias("n_open"), F.sum("quantity").cast("bigint").alias("quantity"), F.round(F.sum("net_kg"), 3).alias("net_kg"), F.count_if(F.col("unit") == "pcs").alias("n_pcs")).drop("block")


def ledger_sheet_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals that agree with the rows they close, that don't, and those that no one can tell."""
    _, totals = ledger_sheets.assemble(_sheets(spark, d), "doc")
    return totals.groupBy("kind", "field", "status").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"), F.round(F.sum("stated"), 2).alias("stated"))


QUERIES = {f.__name__: f for f in (ledger_sheet_rows, ledger_sheet_totals)}

_LINES = """WITH l AS (SELECT l_orderkey // 12 AS doc, l_orderkey % 2 AS half, l_orderkey AS o, l_partkey, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_partkey % 23 <> 0 THEN CAST(l_quantity AS BIGINT) END AS known, (l_partkey % 50 + 1) AS net, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0.45359237::DOUBLE END AS scale FROM lineitem)"""
SQL = {
    "ledger_sheet_rows": f"{_LINES} SELECT doc, count(*) AS n_rows, count(*) FILTER (known IS NULL) AS n_open, CAST(sum(known) AS BIGINT) AS quantity, round(sum(round(net * scale, 8)), 3) AS net_kg, count(*) FILTER (known IS NOT NULL AND l_partkey % 3 = 0) AS n_pcs FROM l GROUP BY doc, half",
    "ledger_sheet_totals": f"""{_LINES}, s AS (SELECT 'section' AS kind, o % 5 = 0 AS wrong, count(*) AS n, count(known) AS k, sum(q) + CASE WHEN o % 5 = 0 THEN 1 ELSE 0 END AS q, sum(net) * any_value(scale) AS net FROM l GROUP BY o UNION ALL SELECT 'grand', false, count(*), count(known), sum(q), sum(net) * any_value(scale) FROM l GROUP BY doc, half)
      SELECT kind, 'quantity' AS field, CASE WHEN k < n THEN 'unknown' WHEN wrong THEN 'mismatch' ELSE 'match' END AS status, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_rows, round(CAST(sum(q) AS DOUBLE), 2) AS stated FROM s GROUP BY 1, 3
      UNION ALL SELECT kind, 'net_kg', 'match', count(*), CAST(sum(n) AS BIGINT), round(sum(net), 2) FROM s GROUP BY 1""",
}
