"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._select import splitters
from ._sketch import count_table
from ._store import bounded, keep, short_batches
from ._text import PUNCT, WHITE, mix, word_blocks

FEATURES = 1 << 20
#: Added to a bucket's document count and to the count that raw text makes expected.
SMOOTH = 2.0
#: A log ratio is pulled to 0 where the counts differ by less than about so many standard deviations.
SURE = 4.0
#: The share of all rows that the sample holds.
SHARE = 0.82
SEED = 20240229
_FIXED = 1 << 38


def _features(texts: list) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, keys): the distinct buckets of rows lo to hi, each key holds the row less lo above the bucket.

    Features are words as written, words without punctuation in lower case, and pairs of those."""
    low, bits = np.uint64(FEATURES - 1), np.uint64(FEATURES.bit_length() - 1)
    for (lo, hi, raw, at), (_, _, bare, own) in zip(word_blocks(texts, lower=False, space=WHITE), word_blocks(texts, lower=True, space=PUNCT), strict=True):
        rows = np.arange(hi - lo, dtype=np.uint64) << bits
        of_raw, of_bare = np.repeat(rows, np.diff(at)), np.repeat(rows, np.diff(own))
        pairs = mix(bare[:-1] * np.uint64(0xA0761D6478BD642F) + bare[1:]) & low | of_bare[1:]
        keys = (mix(raw + np.uint64(1)) & low | of_raw, mix(bare + np.uint64(2)) & low | of_bare, pairs[of_bare[1:] == of_bare[:-1]])
        yield lo, hi, np.unique(np.concatenate(keys)).astype(np.int64)


def _log_ratio(target: np.ndarray, raw: np.ndarray, share: float) -> np.ndarray:
    """log p(bucket | target) / p(bucket | raw) of two models of a document as a set of buckets; share: target documents of all.

    Counts that agree but for chance say nothing of a text, and a sum over hundreds of them would drown what does:
    with z the difference in standard deviations, the ratio is weighed by z^4 / (z^4 + SURE^4).
    """
    expected = raw * share
    z4 = ((target - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)) ** 2
    return np.log((target + SMOOTH) / (expected + SMOOTH)) * (z4 / (z4 + SURE**4))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket. The target model counts all documents labelled good (quality 1, not toxic), the raw model all documents."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    good = bounded(keep(good.where("good = 1").select(F.col(id_col).alias("_id"), "good"), "good"))
    rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("text")).join(good, F.col("_of") == F.col("_id"), "left").select("text", "good")

    def add(batch: pa.RecordBatch, table: np.ndarray) -> None:
        good = np.array([g is not None for g in batch.column("good").to_pylist()], dtype=bool)
        for lo, _, keys in _features(batch.column("text").to_pylist()):
            table[:FEATURES] += np.bincount(keys & (FEATURES - 1), minlength=FEATURES)
            table[FEATURES:] += np.bincount(keys[good[lo + keys // FEATURES]] & (FEATURES - 1), minlength=FEATURES)

    counts = count_table(rows, 2 * FEATURES, add)
    total, chosen = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    return _log_ratio(counts[FEATURES:], counts[:FEATURES], chosen / total) if chosen else np.zeros(FEATURES)


def weigher(spark: SparkSession, ratio: np.ndarray):
    """A column function: log importance weight of a text."""
    sent = spark.sparkContext.broadcast(ratio.astype(np.float32))  # 4 MB

    @F.pandas_udf("double")
    def weight(text: pd.Series) -> pd.Series:
        table, out = sent.value, np.zeros(len(text))
        for lo, hi, keys in _features(text.tolist()):
            out[lo:hi] = np.bincount(keys // FEATURES, weights=table[keys & (FEATURES - 1)], minlength=hi - lo)
        return pd.Series(out)

    return weight


def gumbel_key(weight: Column, id_col: Column) -> Column:
    """log weight + Gumbel noise of the id, as a fixed-point integer below 2**60. The largest k are a sample of k without
    replacement, drawn in proportion to the weights."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.coalesce(id_col.cast("string"), F.lit(""))), 11).cast("double") + 0.5) / float(1 << 53)
    noisy = weight - F.log(-F.log(u))
    return F.floor((F.greatest(F.least(noisy, F.lit(1e6)), F.lit(-1e6)) + float(1 << 20)) * float(_FIXED)).cast("bigint")


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> tuple[DataFrame, int]:
    """All rows as (id, h, log_weight, sample_key), h a hash of the text, and the least key of the sample."""
    spark = docs.sparkSession
    short_batches(spark)
    weight = weigher(spark, fit(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), weight(F.col(text_col)).alias("log_weight"))
    rows = keep(rows.withColumn("sample_key", gumbel_key(F.col("log_weight"), F.col("id"))), "weights")
    total = rows.count()
    out = total - math.ceil(share * total)
    edge = splitters(rows.select(F.col("sample_key").alias("key"), F.lit(1).cast("bigint").alias("weight")), [out], 0)[0] if out else 0
    return rows, edge


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of docs in the sample: the share of the rows with the largest keys (with equal keys at the edge, all of them).

    The edge is found by exact histograms. Null or empty text: weight 0, as a text without known features. Very long texts are weighed whole,
    each bucket once. No labels, or none good: all weights are 0, and noise alone draws the sample. Rows that repeat an id and a text
    share a key and a fate. Null ids are weighed like others. Labels of unknown ids are ignored; an id labelled twice is
    good only if all its labels are. Columns of docs are left as they are, whatever their names.
    """
    rows, edge = sampled(docs, labels, id_col, text_col, share)
    gone = bounded(keep(rows.where(F.col("sample_key") < edge).select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h")).distinct(), "gone"))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text_col) == F.col("_gone_h")), "left_anti")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows, edge = sampled(docs.select("doc_id", "text"), labels)
    return rows.where(F.col("sample_key") >= edge).select(F.col("id").alias("doc_id"), "log_weight", "sample_key")
