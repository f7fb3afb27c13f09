"""Crates and levelled schedules over the given tables, each with the SQL that states the same result or what must hold of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators import crating, levelling, storage
from .tables import SQL_CARGO, cargo, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Cargo rows, every seventh a thin panel, some pieces over any cap."""
    k, kg = F.col("part_no") % 7, F.col("weight_kg") * F.col("qty")
    total = F.when(k == 1, kg / 2).otherwise(kg / 16).cast("double")
    return cargo(spark, d).select("shipment_id", "row_id", F.col("length_mm").alias("l"), F.col("width_mm").alias("w"), F.when(k == 0, 20).otherwise(F.col("height_mm")).alias("h"), "qty", total.alias("total_kg"))


_ROWS = f"""WITH {SQL_CARGO}, r AS (SELECT shipment_id, row_id, length_mm AS l, width_mm AS w, CASE WHEN part_no % 7 = 0 THEN 20 ELSE height_mm END AS h, qty, CASE WHEN part_no % 7 = 1 THEN (weight_kg * qty) / 2 ELSE (weight_kg * qty) / 16 END::DOUBLE AS total_kg FROM cargo)"""
_CAP = "least(3200.0::DOUBLE, CASE " + " ".join(f"WHEN l >= {a} THEN {b}" for a, b in crating.CAPS) + " ELSE 3200 END)"
_THIN, _ACROSS = "least(w, h)", "greatest(least(w, h), 20)"
_PILED = f"CASE WHEN greatest(w, h) >= 1100 THEN least(12, CASE WHEN l <= 2200 THEN 2000 ELSE 1100 END // {_THIN}, 1200 // {_THIN}) WHEN greatest(w, h) >= 1000 THEN least(CASE WHEN l <= 2200 THEN 2000 ELSE 1100 END // {_THIN}, 1200 // {_THIN}) ELSE CASE WHEN l <= 2200 THEN 2000 ELSE 1100 END // {_THIN} END"
_ROOM = f"CASE WHEN flat THEN greatest(1, {_PILED}) WHEN l >= 3500 THEN greatest(1, greatest(1, 1000 // {_ACROSS}) * greatest(1, 1100 // {_ACROSS}) // 2) ELSE 4 * greatest(1, 1100 // greatest(least(w, h), 50)) END"
_LIMIT = "CASE WHEN flat THEN least(cap, 1500) WHEN l >= 5000 THEN least(cap, 280) WHEN l >= 3500 THEN least(cap, 900) ELSE cap END"
_SPLIT = f"""{_ROWS}, u AS (SELECT *, total_kg / qty AS unit, {_CAP} AS cap, greatest(w, h) >= 400 AND least(w, h) <= 80 AS flat FROM r),
  m AS (SELECT *, CAST(greatest(2, ceil(unit / cap - 1e-9)) AS INT) AS n, greatest(1, least(qty, greatest(1, floor({_LIMIT} / unit)), {_ROOM})) AS most0 FROM u),
  m2 AS (SELECT *, CAST(CASE WHEN most0 >= qty AND total_kg > cap + 1e-6 THEN greatest(1, qty // 2) ELSE most0 END AS INT) AS most FROM m),
  parts AS (SELECT shipment_id, row_id, k AS part, l, w, h, NULL::INT AS pieces, CASE WHEN k % n = 0 THEN round(unit - round(unit / n, 3) * (n - 1), 3) ELSE round(unit / n, 3) END AS net_kg FROM (SELECT *, unnest(range(1, n * qty + 1)) AS k FROM m2 WHERE unit > cap + 1e-6)
    UNION ALL SELECT shipment_id, row_id, k, l, w, h, least(most, qty - (k - 1) * most)::INT, round(unit * least(most, qty - (k - 1) * most), 3) FROM (SELECT *, unnest(range(1, CAST(ceil(qty / most) AS INT) + 1)) AS k FROM m2 WHERE unit <= cap + 1e-6))"""


def _sql_fits(name: str) -> str:
    _, l, w, h, wall, _, _ = next(r for r in crating.CRATES if r[0] == name)  # noqa: E741
    return f"((l + 50 <= {l - 2 * wall} OR l + 50 + {2 * wall} <= {max(l * 1.2, l + 800)}) AND ((w + 50 <= {w - 2 * wall} AND h + 50 <= {h - 2 * wall}) OR (w + 50 <= {h - 2 * wall} AND h + 50 <= {w - 2 * wall})))"


def _sql_type() -> str:
    payload = {r[0]: r[6] for r in crating.CRATES}
    out = ""
    for most, names in crating.TIERS:
        pick = "CASE " + " ".join(f"WHEN {_sql_fits(n)} AND net_kg <= {payload[n]} + 1e-6 THEN '{n}'" for n in names) + " " + " ".join(f"WHEN {_sql_fits(n)} THEN '{n}'" for n in names) + f" ELSE '{crating.CRATES[-1][0]}' END"
        out += f" WHEN l <= {most} THEN {pick}" if most else f" ELSE {pick} END"
    return f"CASE{out}"


def crate_split(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each row: pieces over the cap cut by weight, others by how many a crate may hold."""
    parts = crating.split_rows(_rows(spark, d), "shipment_id", "row_id")
    return parts.groupBy("shipment_id", "row_id").agg(F.count("*").alias("n_parts"), F.sum("pieces").alias("n_pieces"), F.round(F.max("net_kg"), 3).alias("heaviest"), F.round(F.sum(F.round(F.col("net_kg") * 1000).cast("bigint")) / 1000, 3).alias("net_kg"))


def crate_pick(spark: SparkSession, d: str) -> DataFrame:
    """How many parts of each band of length go into which type."""
    kinds = crating.part_kinds(_rows(spark, d), "shipment_id", "row_id")
    named = kinds.select(crating.length_band(F.col("l")).alias("band"), crating.crate_type(F.col("l"), F.col("w"), F.col("h"), F.col("net_kg")).alias("crate_type"), "times")
    return named.groupBy("band", "crate_type").agg(F.sum("times").alias("n"))


def crate_build(spark: SparkSession, d: str) -> DataFrame:
    return crating.build_crates(_rows(spark, d), "shipment_id", "row_id")


def crate_verify(spark: SparkSession, d: str) -> DataFrame:
    """Rows and pieces in crates, and faults: none is right; more parts than crates, as parts are put together."""
    rows = _rows(spark, d)
    built = storage.written(crating.equal_crates(rows, "shipment_id", "row_id"))
    faults = crating.crate_faults(built, rows, "shipment_id", "row_id").agg(F.count("*").alias("faults"))
    crates = built.groupBy("shipment_id", "crate_no").agg(F.first("crates").alias("n")).agg(F.sum("n").alias("crates"))
    parts = F.size("parts")
    held = built.groupBy("shipment_id", "row_id").agg(F.sum(parts).alias("n"), F.sum(F.col("pieces") * parts).alias("pieces")).agg(F.sum("n").alias("n_parts"), F.count("*").alias("n_rows"), F.sum("pieces").alias("n_pieces"))
    return held.crossJoin(crates).crossJoin(faults).select("n_parts", "n_rows", "n_pieces", (F.col("crates") < F.col("n_parts")).alias("together"), "faults")  # one row each


def _plans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as plans: a task a line, each after the line before it or the one before that, two crews by supplier."""
    line = F.col("l_linenumber").cast("bigint")
    tasks = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 6).alias("plan"), F.col("l_orderkey"), line.alias("line"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    tasks = tasks.withColumn("id", F.row_number().over(_order()).cast("bigint")).withColumn("duration", F.col("q") % 9)
    back = F.when(F.col("l_partkey") % 2 == 0, F.lag("duration", 1).over(_order())).otherwise(F.lag("duration", 2).over(_order()))
    tasks = storage.written(tasks.withColumn("back", back))
    before = F.col("id") - 1 - F.col("l_partkey") % 2
    links = tasks.where((before > 0) & (F.col("l_suppkey") % 3 > 0)).select("plan", before.alias("before"), F.col("id").alias("after"), (F.col("back") + F.col("id") % 3 - 1).alias("weight"))
    demands = tasks.select("plan", "id", F.concat(F.lit("crew"), F.col("l_suppkey") % 2).alias("resource"), (F.col("q") % 3 + 1).alias("units"))
    capacities = tasks.select("plan").distinct().select("plan", F.explode(F.expr("array(struct('crew0' AS resource, 4 AS capacity), struct('crew1' AS resource, 3 AS capacity))")).alias("c")).select("plan", "c.*")
    return tasks.select("plan", "id", "duration"), links, demands, capacities


def _order() -> WindowSpec:
    return Window.partitionBy("plan").orderBy("l_orderkey", "line", "l_partkey", "l_suppkey")


def schedule_levelled(spark: SparkSession, d: str) -> DataFrame:
    return levelling.level(*_plans(spark, d))


def schedule_levelled_verify(spark: SparkSession, d: str) -> DataFrame:
    """Tasks, tasks with a start, plans, work in days, and faults of the schedules: none is right."""
    tasks, links, demands, capacities = _plans(spark, d)
    found = storage.written(levelling.level(tasks, links, demands, capacities))
    faults = levelling.levelling_faults(found, links, demands, capacities).agg(F.count("*").alias("faults"))
    return found.agg(F.count("*").alias("n_tasks"), F.count("start").alias("n_started"), F.count_distinct("plan").alias("n_plans"), F.sum(F.col("end") - F.col("start")).alias("days")).crossJoin(faults)  # one row each


QUERIES = {f.__name__: f for f in (crate_split, crate_pick, crate_build, crate_verify, schedule_levelled, schedule_levelled_verify)}

_BAND = "CASE " + " ".join(f"WHEN l >= {least} THEN '{name}'" for least, name, _ in crating.BANDS) + " ELSE '1m' END"
SQL = {
    "crate_split": f"{_SPLIT} SELECT shipment_id, row_id, count(*) AS n_parts, CAST(sum(pieces) AS BIGINT) AS n_pieces, round(max(net_kg), 3) AS heaviest, round(CAST(sum(CAST(round(net_kg * 1000) AS BIGINT)) AS BIGINT) / 1000, 3) AS net_kg FROM parts GROUP BY 1, 2",
    "crate_pick": f"{_SPLIT} SELECT {_BAND} AS band, {_sql_type()} AS crate_type, count(*) AS n FROM parts GROUP BY 1, 2",
    "crate_verify": f"{_SPLIT} SELECT count(*) AS n_parts, count(DISTINCT (shipment_id, row_id)) AS n_rows, CAST(sum(pieces) AS BIGINT) AS n_pieces, true AS together, 0::BIGINT AS faults FROM parts",
    "schedule_levelled_verify": "SELECT count(*) AS n_tasks, count(*) AS n_started, count(DISTINCT l_orderkey // 6) AS n_plans, CAST(sum(CAST(l_quantity AS INT) % 9) AS BIGINT) AS days, 0::BIGINT AS faults FROM lineitem",
}
