"""The corpus pipeline: raw documents in, sharded training mix out.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents,
the last one with its shard and slot besides. No stage caps, samples to size or drops rows but by its own decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestow.llm._store import bounded, keep
from lodestow.llm.op1_decontamination import contamination
from lodestow.llm.op4_quality import resample
from lodestow.llm.op5_sharding import SHARDS, shard
from lodestow.llm.op6_jaccard import jaccard_components
from lodestow.llm.op9_mixing import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance resampling keeps; labels are those of the table."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked at 0.8 on five-word shingles the document with the smallest id.

    Rows that repeat an id are copies: the one with the smallest text stays. Rows with a null id belong to no component and stay.
    """
    joined = keep(jaccard_components(docs, n=5, threshold=(80, 100)).select("doc_id", "component_id"), "components")
    # Those that go are fewer than those that stay, and texts need not move to meet a short list.
    gone = keep(joined.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    stay = docs.join(bounded(gone), "doc_id", "left_anti").select(*COLUMNS)
    named, ids = joined.where("doc_id IS NOT NULL").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if named == ids:
        return stay
    one = Window.partitionBy("doc_id").orderBy("text", *COLUMNS[2:])
    first = stay.where("doc_id IS NOT NULL").withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*COLUMNS)
    return first.unionByName(stay.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    found = keep(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "found")
    return docs.join(bounded(found), "doc_id", "left_anti").select(*COLUMNS)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text cut to the word ranges taken, or whole where none are given; what lies between two words of a range stays as it is."""
    for batch in batches:
        texts = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
            if ranges:
                places = [m.span() for m in _WORD.finditer(text)]
                text = "\n".join(text[places[r["a"]][0] : places[r["b"] - 1][1]] for r in ranges)
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in (*COLUMNS, "_cut")]
        yield pa.record_batch(columns, names=[*COLUMNS, "_cut"])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row as often as the whole source is taken, and one more with the words of its blocks taken once more.

    Blocks that touch are one range; ranges are joined by line breaks. A row of which nothing is taken goes.
    """
    # The plan is made without the texts, which move once, to meet it. Rows that are equal in all columns are told
    # apart by their number among themselves; which of them gets which part of the plan makes no difference.
    keyed = docs.withColumns({"_h": F.xxhash64(*COLUMNS), "_g": F.xxhash64(F.lit(1), *COLUMNS)})
    plan = mix(keyed.withColumn("_key", F.struct("_h", "_g")), id_col="_key").select("_key._h", "_key._g", "size", "whole", "picks")
    merged = F.expr(
        """aggregate(picks, cast(array() AS array<struct<a: bigint, b: bigint>>), (s, p) -> CASE WHEN get(s, size(s) - 1).b = p.a
             THEN concat(slice(s, 1, size(s) - 1), array(struct(get(s, size(s) - 1).a AS a, p.b AS b))) ELSE concat(s, array(struct(p.a AS a, p.b AS b))) END)"""
    )
    plan = plan.withColumn("_ranges", merged)
    # A row taken whole once more is a whole row.
    plan = plan.withColumn("whole", F.expr("whole + int(size(_ranges) = 1 AND get(_ranges, 0).a = 0 AND get(_ranges, 0).b = size)"))
    plan = plan.withColumn("_ranges", F.expr("IF(size(_ranges) = 1 AND get(_ranges, 0).a = 0 AND get(_ranges, 0).b = size, cast(array() AS array<struct<a: bigint, b: bigint>>), _ranges)"))
    plan = plan.withColumn("_nth", F.row_number().over(Window.partitionBy("_h", "_g").orderBy("whole", "_ranges"))).where("whole > 0 OR size(_ranges) > 0")
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_h", "_g").orderBy("doc_id")))
    # Written so, the numbers are no join key, and the exchange for the window serves the join.
    met = keyed.join(plan.select("_h", "_g", "whole", "_ranges", "_nth"), ["_h", "_g"]).where("_n - _nth = 0")
    none = "cast(array() AS array<struct<a: bigint, b: bigint>>)"
    times = F.explode(F.expr(f"concat(array_repeat({none}, int(whole)), IF(size(_ranges) > 0, array(_ranges), array()))")).alias("_ranges")
    rows = met.select(*COLUMNS, times)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*COLUMNS).schema)
    n_chars = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
    part = rows.withColumn("_cut", F.size("_ranges") > 0)
    return part.mapInArrow(_cut, schema + ", _cut boolean").withColumn("n_chars", F.when(F.col("_cut"), n_chars).otherwise(F.col("n_chars"))).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot."""
    return shard(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: The first stage fits a model and draws hashed noise, which SQL can't state; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
