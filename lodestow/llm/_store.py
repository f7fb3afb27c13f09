"""Intermediate results that survive lost executors, kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids is sent to all executors up to so many rows (some 32 MB); a longer one is joined by a shuffle.
SENT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder in ``spark.checkpoint.dir``; only where that is unset (tests), a local folder of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        there = "file://" + tempfile.mkdtemp(prefix="lodestow-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: send 1,000 of them to a Python worker at a time, unless the session asks for another number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and pins values that a recomputation could change."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """df, kept in buckets of key, so that joins and groups on key need no exchange. Its table is gone afterwards; its files stay."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").bucketBy(parts, key).option("path", f"{shared_dir(spark)}/lodestow/{table}").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def bounded(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if a count of them allows. ids should be kept or cheap: they are counted here."""
    return F.broadcast(ids) if ids.limit(SENT_ROWS + 1).count() <= SENT_ROWS else ids
