"""Input tables and the cargo view over them, stated once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inner sizes in mm, payload in kg, volume in cubic metres, practical volume, tare.
CONTAINERS = [
    ("20GP", 5898, 2352, 2385, 21000.0, 33.2, 27.0, 2200.0),
    ("40GP", 12032, 2352, 2385, 26680.0, 67.7, 56.0, 3800.0),
    ("40HQ", 12032, 2352, 2698, 28610.0, 76.4, 65.0, 3900.0),
]
CONTAINER_COLUMNS = ["type", "inner_l", "inner_w", "inner_h", "payload_kg", "theory_m3", "practical_m3", "tare_kg"]
#: How much the packed volume of a category exceeds the volume of its pieces, in hundredths.
PACK_FACTORS = {"steel": 130, "aluminum_profile": 135, "aluminum_panel": 150, "glass": 180, "hardware": 140, "timber_panel": 145, "general": 140}
TYPE_CATEGORY = {"ECONOMY": "steel", "SMALL": "hardware", "MEDIUM": "aluminum_profile", "LARGE": "aluminum_panel", "PROMO": "glass", "STANDARD": "general"}


def containers(spark: SparkSession) -> DataFrame:
    """The container dimension: three rows of fixed values."""
    return spark.createDataFrame(CONTAINERS, CONTAINER_COLUMNS)


def cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item, with sizes and weight made from its part number by whole-number rules."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    key = F.col("p_partkey")
    category = F.coalesce(*(F.when(F.col("p_type") == t, F.lit(c)) for t, c in TYPE_CATEGORY.items()), F.lit("general"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return items.join(parts, F.col("l_partkey") == key).select(
        F.col("l_orderkey").alias("shipment_id"), F.row_number().over(order).cast("bigint").alias("row_id"), F.col("l_partkey").alias("part_no"), F.col("p_name").alias("name"), category.alias("category"),
        F.col("l_quantity").cast("bigint").alias("qty"), (300 + key * 37 % 5700).alias("length_mm"), (200 + key * 53 % 1500).alias("width_mm"), (100 + key * 29 % 1200).alias("height_mm"),
        (50 + key * 71 % 2400).alias("weight_kg"), F.col("l_suppkey").alias("supplier_id"),
    )


_CASES = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in TYPE_CATEGORY.items())
_VALUES = ", ".join(str(row) for row in CONTAINERS)
SQL_CARGO = f"""cargo AS (
  SELECT l_orderkey AS shipment_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_id, l_partkey AS part_no, p_name AS name,
    CASE p_type {_CASES} ELSE 'general' END AS category, CAST(l_quantity AS BIGINT) AS qty, 300 + p_partkey * 37 % 5700 AS length_mm, 200 + p_partkey * 53 % 1500 AS width_mm,
    100 + p_partkey * 29 % 1200 AS height_mm, 50 + p_partkey * 71 % 2400 AS weight_kg, l_suppkey AS supplier_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SQL_CONTAINERS = f"containers({', '.join(CONTAINER_COLUMNS)}) AS (VALUES {_VALUES})"
SQL_FACTOR = "CASE category " + " ".join(f"WHEN '{c}' THEN {f}" for c, f in PACK_FACTORS.items()) + " ELSE 140 END"
