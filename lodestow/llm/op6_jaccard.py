"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._graph import components
from ._sketch import count_table
from ._store import bounded, keep, short_batches
from ._text import as_long, mix, ngrams, shingle_set, word_blocks

_WORDS64 = 8  # a signature of 512 bits
_ROUNDS = 4  # independent minimum hashes of the first round
_SKETCH = 1 << 21
_BITS = [f"b{k}" for k in range(_WORDS64)]
_MINS = [f"m{k}" for k in range(_ROUNDS)]


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def _signatures(n: int):
    """Per text: size of its set, 128 bits of its word sequence, parity bitmap, minimum hashes."""
    fields = [("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), *((b, pa.int64()) for b in _BITS), *((m, pa.int64()) for m in _MINS)]
    salts = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k in range(_ROUNDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _columns(batch, "id", "text")
            out = np.zeros((len(fields) - 1, len(ids)), dtype=np.uint64)
            for lo, hi, words, bounds in word_blocks(texts):
                for row in range(lo, hi):
                    own = words[bounds[row - lo] : bounds[row - lo + 1]]
                    shingles = shingle_set(own, n)
                    out[0, row] = len(shingles)
                    if not len(own):
                        continue
                    place = np.arange(1, len(own) + 1, dtype=np.uint64)
                    out[1, row] = mix(own * (place * np.uint64(2) + np.uint64(1)) + place).sum(dtype=np.uint64)
                    out[2, row] = mix((own ^ np.uint64(0x5851F42D4C957F2D)) * (place * np.uint64(6364136223846793005) | np.uint64(1))).sum(dtype=np.uint64)
                    bit = (shingles >> np.uint64(20)) & np.uint64(64 * _WORDS64 - 1)
                    odd = np.bincount(bit.astype(np.int64), minlength=64 * _WORDS64).astype(np.uint64) & np.uint64(1)
                    out[3 : 3 + _WORDS64, row] = (odd.reshape(_WORDS64, 64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    for k, salt in enumerate(salts):
                        out[3 + _WORDS64 + k, row] = mix(shingles ^ salt).min()
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(as_long(x)) for x in out)], schema=pa.schema(fields))

    return run, ", ".join(f"{name} bigint" for name, _ in fields)


def _postings(n: int, t: tuple[int, int], counts) -> tuple:
    """(hash, id) of the prefix of each set, rarest shingles first; a text that a task has seen is left out."""
    schema = pa.schema([("hash", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for batch in batches:
            ids, texts = _columns(batch, "id", "text")
            hashes, owner = [], []
            for lo, hi, words, bounds in word_blocks(texts):
                for row in range(lo, hi):
                    own = words[bounds[row - lo] : bounds[row - lo + 1]]
                    if not len(own) or (key := own.tobytes() if len(own) < 16 else hash(own.tobytes())) in seen:
                        continue
                    seen.add(key)
                    shingles = shingle_set(own, n)
                    size = len(shingles)
                    length = size - -(-t[0] * size // t[1]) + 1
                    rank = (table[(shingles & np.uint64(_SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (shingles >> np.uint64(32))
                    chosen = shingles[rank <= np.partition(rank, length - 1)[length - 1]]
                    hashes.append(chosen)
                    owner.append(np.full(len(chosen), ids[row], np.int64))
            if hashes:
                yield pa.record_batch([pa.array(as_long(np.concatenate(hashes))), pa.array(np.concatenate(owner))], schema=schema)

    return run, "hash bigint, id bigint"


def _verify(n: int, t: tuple[int, int]):
    """Keeps the pairs whose exact sets reach the threshold, by intersection of sorted arrays."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(texts: list[str]) -> list[np.ndarray]:
        return [shingle_set(words[bounds[k] : bounds[k + 1]], n) for lo, hi, words, bounds in word_blocks(texts) for k in range(hi - lo)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b, left, right = _columns(batch, "a", "b", "text_a", "text_b")
                good = []
                for k, (x, y) in enumerate(zip(sets(left), sets(right), strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common and t[1] * common >= t[0] * (len(x) + len(y) - common):
                        good.append(k)
                yield pa.record_batch([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], schema=schema)

    return run, "a bigint, b bigint"


def _bound(t: tuple[int, int], x: str = "x", y: str = "y") -> Column:
    """Sizes and signatures allow the threshold. Each shingle that only one set has flips one bit, so with h bits
    that differ the overlap is (|x| + |y| - h) / 2 at most, and J >= p / q needs (p + q) * overlap >= p * (|x| + |y|)."""
    p, q = t
    differ = " + ".join(f"bit_count({x}.{b} ^ {y}.{b})" for b in _BITS)
    return F.expr(f"{q} * least({x}.n, {y}.n) >= {p} * greatest({x}.n, {y}.n) AND {p + q} * ({x}.n + {y}.n - ({differ})) >= {2 * p} * ({x}.n + {y}.n)")


def _linked(pairs: DataFrame, docs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    pairs = keep(pairs.distinct(), "pairs")
    # A semi join first: only texts that are in a pair move.
    ids = keep(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = docs.join(bounded(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return keep(both.mapInArrow(*_verify(n, t)), "links")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): classes of texts that links of Jaccard >= p / q reach, over sets of n-word shingles.

    1. Texts of one word sequence are one class, so that copies cost a row, not pairs.
    2. First round: of the texts that share one of four minimum hashes, each is compared with one only, the one that
       shares its hashes with most others, and verified. This joins the large groups of near copies.
    3. Exact round: each set posts its prefix of rarest shingles (two sets at the threshold share one).
       Tiles are a shingle and a band of set sizes; a pair meets in the bands p / q apart only. Texts already
       joined are not paired again; bitmaps bound the overlap before texts move and sorted arrays decide.
    Rarity comes from a count table over all shingles of fixed size; any order finds every pair.

    Null or blank text: an empty set, linked with nothing. Rows of one id are one document: each has its own set, and all
    its links are the document's. A null id: its set is counted, its component is null. Ties need no rule: components
    are named by their smallest id. Empty table: no rows. Ids are integers.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("key", F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")))
    if keyed.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").isEmpty():
        out = _components(docs, n, threshold)
    else:  # some id has different texts: link texts first, then the texts of each id
        texts = keep(_components(keyed.select(F.col("key").alias("id"), "text"), n, threshold).withColumnRenamed("id", "key"), "texts")
        owner = keyed.where("id IS NOT NULL").select("id", "key").distinct()
        owned = keep(owner.join(texts.groupBy("key").agg(F.first("component_id").alias("text_class")), "key"), "owned")
        low = owned.groupBy("id").agg(F.min("text_class").alias("low"))
        joined = components(owned.join(low, "id").select(F.col("text_class").alias("a"), F.col("low").alias("b")))
        owned = keep(owned.join(joined, F.col("text_class") == F.col("node"), "left").select("id", "key", F.coalesce("component", "text_class").alias("class")), "owned")
        named = owned.join(owned.groupBy("class").agg(F.min("id").alias("component_id")), "class").select("id", "key", "component_id")
        out = texts.drop("component_id").join(named, "key", "left").select("id", "n_shingles", "component_id")
    return out.withColumnRenamed("id", id_col)


def _components(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(id, n_shingles, component_id) of docs(id, text) in which no id has two texts."""
    spark = docs.sparkSession
    short_batches(spark)
    every = keep(docs.mapInArrow(*_signatures(n)), "signatures")
    named = every.where("id IS NOT NULL AND n > 0")
    classes = named.groupBy("k1", "k2").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ["n", *_BITS, *_MINS]))
    classes = keep(classes.groupBy("rep").agg(*(F.first(c).alias(c) for c in ["k1", "k2", "n", *_BITS, *_MINS])), "classes")

    # First round.
    spread = classes.select("rep", F.posexplode(F.array(*_MINS)).alias("round", "low"))
    sizes = spread.groupBy("round", "low").agg(F.count("*").alias("many")).where("many > 1")
    crowd = spread.join(sizes, ["round", "low"]).groupBy("rep").agg(F.sum("many").alias("crowd"))
    # The text that agrees with most others is the middle of its group: edits take a text away from all others.
    crowded = keep(classes.join(crowd, "rep"), "crowded")
    spread = crowded.select("rep", "n", "crowd", *_BITS, F.posexplode(F.array(*_MINS)).alias("round", "low"))
    lead = spread.groupBy("round", "low").agg(F.min(F.struct(-F.col("crowd"), "rep", "n", *_BITS)).alias("y"))
    met = spread.select("round", "low", F.struct("n", "rep", *_BITS).alias("x")).join(lead, ["round", "low"]).where("x.rep <> y.rep").where(_bound(threshold))
    first = _linked(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")), docs, n, threshold)
    found = components(first)
    labels = classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", "rep", F.coalesce("component", "rep").alias("label"), "n", *_BITS)
    labels = keep(labels, "labels")

    # Exact round.
    def add(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for lo, hi, words, bounds in word_blocks(batch.column("text").to_pylist()):
            grams = ngrams(words, n)  # those across two texts are few and only blur the order
            np.add.at(table, (grams & np.uint64(_SKETCH - 1)).astype(np.int64), 1)

    counts = spark.sparkContext.broadcast(np.minimum(count_table(docs.select("text"), _SKETCH, add), 2**31 - 1).astype(np.int32))
    by_hash = Window.partitionBy("hash")
    posted = docs.where("id IS NOT NULL").mapInArrow(*_postings(n, threshold, counts))
    shared = posted.withColumn("lo", F.min("id").over(by_hash)).withColumn("hi", F.max("id").over(by_hash)).where("lo < hi").select("hash", "id")
    owner = named.select("id", "k1", "k2").join(labels.select("k1", "k2", "rep", "label"), ["k1", "k2"]).drop("k1", "k2")
    shared = shared.join(owner, "id").drop("id")
    # Most tiles hold texts of one label only and go here, before sizes and bitmaps join the rows.
    open_ = shared.withColumn("lo", F.min("label").over(by_hash)).withColumn("hi", F.max("label").over(by_hash)).where("lo < hi").select("hash", "rep", "label").distinct()
    open_ = open_.join(labels.select("rep", "n", *_BITS), "rep")
    width = -math.log(threshold[0] / threshold[1])
    open_ = keep(open_.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width))), "tiles")
    x = open_.select("hash", "band", F.struct("rep", "label", "n", "band", *_BITS).alias("x"))
    y = open_.select("hash", F.struct("rep", "label", "n", "band", *_BITS).alias("y"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    met = x.join(y, ["hash", "band"]).where("x.label <> y.label AND (x.band < y.band OR x.rep < y.rep)").where(_bound(threshold))
    second = _linked(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")), docs, n, threshold)

    names = labels.select("rep", "label")
    ends = second.join(names.withColumnsRenamed({"rep": "a", "label": "la"}), "a").join(names.withColumnsRenamed({"rep": "b", "label": "lb"}), "b")
    merged = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    final = labels.join(merged, F.col("label") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "label").alias("component_id"))
    out = every.join(final, ["k1", "k2"], "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"))
    return out


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, threshold=(85, 100))
