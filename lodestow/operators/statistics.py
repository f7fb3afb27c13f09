"""Order statistics of groups of any size, from counts of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, keys: list[str], value: Column, name: str = "upper_median") -> DataFrame:
    """(keys, n, name): of an even number of values the higher middle one, nulls left out.

    Equal values are counted before they are exchanged, and running counts over the sorted values find the middle, so no group is held as a list.
    """
    counts = rows.select(*keys, value.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    running = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    met = running.join(totals, keys) if keys else running.crossJoin(totals)  # one row
    return met.where(F.col("_upto") > F.floor(F.col("n") / 2)).groupBy(*keys, "n").agg(F.min("_v").alias(name))
