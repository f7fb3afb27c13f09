"""Histogram sort into shards of near-equal bytes, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._select import splitters
from ._store import keep

SHARDS = 40
#: Splitters are refined until the bytes below are within this share of a shard of the target.
TOLERANCE = 0.001
_KEY_BITS = 60
_CELL_BITS = 12


def sort_key(id_col: Column) -> Column:
    """60 bits from the id, the same in every run and every engine with MD5; a null id counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16


def plan_shards(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The shards - 1 boundaries, ascending; keys(key, weight)."""
    total = keys.agg(F.sum("weight")).first()[0] or 0
    return splitters(keys, [total * k // shards for k in range(1, shards)], int(total / shards * tolerance), _KEY_BITS)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, shard, slot added under those names (``_size``, ``_shard``, ``_slot`` where docs has such a column).

    Rows are sorted by a hash of their id, so equal texts, sources and neighbours spread evenly; splitters
    come from counts of exact bytes; the rows are exchanged once, by shard and range of the key, so that no
    task holds a whole shard. Slots count from 0 in key order, then id, then text.

    Null text: size 16. Empty table: no rows. Rows that repeat an id have one key and share a shard, in
    adjacent slots; shards are equal up to the rows of one id.
    """
    name = {c: c if c not in docs.columns else "_" + c for c in ("size", "shard", "slot")}
    return _place(docs.withColumn(name["size"], byte_size(F.col(text_col))), name, shards, id_col, [text_col])


def _place(docs: DataFrame, name: dict[str, str], shards: int, id_col: str, ties: list[str]) -> DataFrame:
    docs = docs.withColumn("__key", sort_key(F.col(id_col)))
    keys = keep(docs.select(F.col("__key").alias("key"), F.col(name["size"]).alias("weight")), "keys")
    bounds = plan_shards(keys, shards)
    number = F.expr("0" + "".join(f" + int(__key >= {b}L)" for b in bounds))  # one integer sum: stays in generated code
    cell = F.shiftright("__key", _KEY_BITS - _CELL_BITS)
    # Rows before each (shard, cell): at most 4,096 cells and shards - 1 more that a boundary cuts.
    counts = keys.withColumnRenamed("key", "__key").groupBy(number.alias("__s"), cell.alias("__c")).count()
    before = counts.select("__s", "__c", (F.sum("count").over(Window.partitionBy("__s").orderBy("__c")) - F.col("count")).alias("__before"))
    placed = docs.withColumn("__s", number).withColumn("__c", cell)
    order = Window.partitionBy("__s", "__c").orderBy("__key", id_col, *ties)
    return (
        placed.withColumn("__rank", F.row_number().over(order) - 1)
        .join(F.broadcast(before), ["__s", "__c"])
        .withColumn(name["shard"], F.col("__s").cast("int"))
        .withColumn(name["slot"], (F.col("__before") + F.col("__rank")).cast("bigint"))
        .drop("__s", "__c", "__key", "__before", "__rank")
    )


def op5_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lean = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), byte_size(F.col("text")).alias("size"))
    # The digest needs no text after its size and checksum, so the rows are exchanged without it.
    placed = _place(keep(lean, "sizes"), {c: c for c in ("size", "shard", "slot")}, SHARDS, "doc_id", ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
