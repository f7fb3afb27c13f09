"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._sketch import count_table
from ._store import bounded, keep, short_batches
from ._text import PUNCT, as_long, ngrams, word_blocks

#: A tile holds this many words at least.
MIN_MATCH = 5
#: A document is contaminated if tiles cover this share of a test item's words.
COVERAGE = 0.8
_TABLE = 1 << 22
_BROADCAST_BYTES = 8 << 20


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the greedy tiling: again and again the longest matches of words in no tile yet.

    Windows of the least length are looked up by their Karp-Rabin hash, then grown word by word.
    Of equally long matches the first in the item, then the first in the document, goes first.
    """
    out: list[tuple[int, int, int]] = []
    if min(len(item), len(doc)) < least:
        return out
    own, other = ngrams(item, least), ngrams(doc, least)
    shared = np.flatnonzero(np.isin(other, own))
    shared = shared[np.argsort(other[shared], kind="stable")]
    hashes = other[shared]
    runs: list[tuple[int, int, int]] = []  # the longest matches without regard to tiles: few even where all words are equal
    for p in np.flatnonzero(np.isin(own, hashes)).tolist():
        q = shared[np.searchsorted(hashes, own[p]) : np.searchsorted(hashes, own[p], "right")]
        if p:
            q = q[(q == 0) | (other[q - 1] != own[p - 1])]  # the others are part of a match that starts earlier
        n = least
        while len(q):
            on = q + n - least + 1 < len(other)
            if p + n - least + 1 < len(own):
                on[on] = other[q[on] + n - least + 1] == own[p + n - least + 1]
            else:
                on[:] = False
            runs.extend((-n, p, x) for x in q[~on].tolist())
            q, n = q[on], n + 1
    heapify(runs)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    left = len(item)
    while runs and left >= least:
        n, p, q = heappop(runs)
        free = free_item[p : p - n] & free_doc[q : q - n]
        if free.all():
            free_item[p : p - n] = free_doc[q : q - n] = False
            left += n
            out.append((p, q, -n))
            continue
        edge = np.diff(free.astype(np.int8), prepend=0, append=0)  # what tiles have left of it waits for its turn
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if hi - lo >= least:
                heappush(runs, (lo - hi, p + lo, q + lo))
    return out


def _seeds(batches: Iterator[pa.RecordBatch], gate=None) -> Iterator[pa.RecordBatch]:
    """Distinct windows of each text, how often it holds them, and its words."""
    for batch in batches:
        ids, hashes, counts, owner, sizes = batch.column("id").to_pylist(), [], [], [], []
        for lo, hi, words, bounds in word_blocks(batch.column("text").to_pylist(), space=PUNCT):
            for k in range(hi - lo):
                own = ngrams(words[bounds[k] : bounds[k + 1]], MIN_MATCH)
                if gate is not None:
                    own = own[gate.value[(own & np.uint64(_TABLE - 1)).astype(np.int64)]]
                own, times = np.unique(own, return_counts=True)
                hashes.append(own)
                counts.append(times)
                owner.append(np.full(len(own), ids[lo + k], np.int64))
                sizes.append(np.full(len(own), bounds[k + 1] - bounds[k], np.int64))
        if hashes:
            yield pa.record_batch([pa.array(as_long(np.concatenate(hashes))), pa.array(np.concatenate(owner)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(sizes))], names=["seed", "id", "times", "words"])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def words(texts: list) -> list[np.ndarray]:
        return [w[bounds[k] : bounds[k + 1]] for lo, hi, w, bounds in word_blocks(texts, space=PUNCT) for k in range(hi - lo)]

    names = ["doc", "item", "covered", "words", "n_tiles", "longest"]
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = []
            for item, doc in zip(words(batch.column("item_text").to_pylist()), words(batch.column("text").to_pylist()), strict=True):
                found = [n for _, _, n in tiles(item, doc)]
                rows.append((sum(found), len(item), len(found), max(found, default=0)))
            columns = [batch.column("doc"), batch.column("item"), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))]
            yield pa.record_batch(columns, names=names)


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, coverage, item_words, n_tiles, longest_tile) of every document that holds a test item, reordered or not.

    Words: runs of letters, digits and other non-ASCII characters, A-Z lower-cased. Documents and items meet by a join
    on shared windows of MIN_MATCH words. A table of the items' windows, of fixed size, keeps other windows from the
    shuffle; its false hits cost time only. A pair goes on only if the item's places
    with a shared window could cover enough: a tile of n words has n - MIN_MATCH + 1 such places, all its own.

    Null texts, and items or documents of fewer than MIN_MATCH words, hold nothing. Rows that repeat an id count once (smallest text).
    Null ids are passed over. Empty tables: no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))

    def add(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for part in _seeds(iter([batch])):
            table[(part.column("seed").to_numpy().view(np.uint64) & np.uint64(_TABLE - 1)).astype(np.int64)] = 1

    gate = spark.sparkContext.broadcast(count_table(items, _TABLE, add) > 0)
    schema = "seed bigint, id bigint, times bigint, words bigint"
    own = items.mapInArrow(_seeds, schema).select("seed", F.col("id").alias("item"), "times", "words")
    hits = docs.mapInArrow(lambda batches: _seeds(batches, gate), schema).select("seed", F.col("id").alias("doc")).distinct()
    pairs = hits.join(own, "seed").groupBy("doc", "item").agg(F.sum("times").alias("shared"), F.max("words").alias("words"))
    pairs = keep(pairs.where(F.col("shared") * MIN_MATCH >= F.col("words") * coverage).select("doc", "item"), "pairs")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    items = items.select(F.col("id").alias("item"), F.col("text").alias("item_text"))
    texts = docs.join(bounded(pairs.select(F.col("doc").alias("id")).distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    both = pairs.join(texts.withColumnRenamed("id", "doc"), "doc").join(F.broadcast(items) if size <= _BROADCAST_BYTES else items, "item")
    tiled = both.select("doc", "item", "text", "item_text").mapInArrow(_tile, "doc bigint, item bigint, covered bigint, words bigint, n_tiles bigint, longest bigint")
    return tiled.where(F.col("covered") >= F.col("words") * coverage).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), (F.col("covered") / F.col("words")).alias("coverage"), F.col("words").alias("item_words"), "n_tiles", F.col("longest").alias("longest_tile")
    )


def op1_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark)
