"""Approximate nearest neighbours by cross-polytope hashing: probed buckets give candidates, exact inner products rank them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import bounded, keep
from ._vectors import finite, matrix, width

K = 20
EVERY = 20
TABLES = 4
SEED = 20240229
#: Hashes are joined to one bucket number until a bucket holds so many vectors in the mean.
BUCKET = 4096
#: A bucket that holds more than this is dealt over several tiles.
TILE = 8192
#: The probes of a table are as many as find this share of the neighbours of the sample.
RECALL = 0.95
#: The sample: so many query vectors, the first by hash, compared with all vectors.
SAMPLE = 256
#: With more than one hash a table, so many buckets are probed at most; if they don't suffice, there is one hash less.
MOST_PROBES = 4096


@dataclass(frozen=True)
class Polytopes:
    """Hash functions of some tables: seeded sign flips and Hadamard transforms, three of each, then the nearest of the 2 * size signed axes.

    Inner products become angles by one more component: a vector is divided by the largest length and filled up to length 1, a query
    has 0 there. The rest up to the next power of two is 0.
    """

    dim: int
    longest: float
    tables: int
    hashes: int
    seed: int = SEED

    @property
    def size(self) -> int:
        return 1 << self.dim.bit_length()

    @property
    def axes(self) -> int:
        return 2 * self.size

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        with np.errstate(over="ignore", under="ignore"):
            if query:
                top = np.abs(x).max(1, keepdims=True, initial=0)
                y = x / np.where(top > 0, top, 1)
                out[:, : self.dim] = y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300)
            else:
                y = x / self.longest
                out[:, : self.dim], out[:, self.dim] = y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
        return out

    def rotate(self, y: np.ndarray, table: int, hash_: int) -> np.ndarray:
        """Coordinates along the signed axes: the first half along the axes, the second against them."""
        signs = np.random.default_rng([self.seed, table, hash_]).integers(0, 2, (3, self.size)) * 2.0 - 1
        n = len(y)
        for sign in signs:
            y, h = y * sign, 1
            while h < self.size:
                z = y.reshape(n, -1, 2, h)
                y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), 2).reshape(n, -1)
                h *= 2
            y = y / math.sqrt(self.size)
        return np.concatenate((y, -y), 1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        y, code = self.lift(x, False), np.zeros(len(x), np.int64)
        for k in range(self.hashes):
            code = code * self.axes + self.rotate(y, table, k).argmax(1)
        return code

    def probes(self, q: np.ndarray, table: int, most: int) -> np.ndarray:
        """For each query its most promising buckets, best first: those with the largest sums of coordinates, over all combinations of axes."""
        y = self.lift(q, True)
        code, total = np.zeros((len(q), 1), np.int64), np.zeros((len(q), 1))
        for k in range(self.hashes):
            total = (total[:, :, None] + self.rotate(y, table, k)[:, None, :]).reshape(len(q), -1)
            code = (code[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(q), -1)
            best = np.argsort(-total, axis=1, kind="stable")[:, :most]
            total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        return code

    @property
    def all_probes(self) -> int:
        return self.axes if self.hashes == 1 else MOST_PROBES


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, always added up in the same order, so that a pair has one score wherever it is met."""
    return (q * x).sum(1)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, v, ids): equal vectors as one, with the k + 1 smallest ids: no more of them can be among the k nearest of any query.

    The limit by rank works before the shuffle too, so a vector that a third of all rows share sends k + 1 rows a task.
    """
    ranked = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    return ranked.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _nearest_exactly(classes: DataFrame, q: np.ndarray, own: list[tuple[int, int]], hashing: Polytopes, k: int) -> list[int | None]:
    """For each of the k nearest classes of each sampled query its place in the order of probing, the best of all tables; None beyond the most probes.

    The sample is of a fixed size and goes to all tasks; a task keeps k classes a query.
    """
    at = {h: i for i, h in enumerate(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = np.full((len(q), k), -np.inf), np.zeros((len(q), k, hashing.dim))
        for batch in batches:
            x = matrix(batch["v"], hashing.dim)
            score = q @ x.T
            for j, h in enumerate(zip(batch["h1"].to_pylist(), batch["h2"].to_pylist(), strict=True)):
                if h in at:
                    score[at[h], j] = -np.inf
            scores, vectors = np.concatenate((best, score), 1), None
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            vectors = np.where((order < k)[:, :, None], np.take_along_axis(held, np.minimum(order, k - 1)[:, :, None], 1), x[np.maximum(order - k, 0)])
            best, held = np.take_along_axis(scores, order, 1), vectors
        place = np.full((len(q), k), hashing.all_probes)
        for t in range(hashing.tables):
            code = hashing.buckets(held.reshape(-1, hashing.dim), t).reshape(len(q), k)
            for i, row in enumerate(hashing.probes(q, t, hashing.all_probes)):
                by = np.argsort(row)
                j = np.minimum(np.searchsorted(row[by], code[i]), len(row) - 1)
                place[i] = np.minimum(place[i], np.where(row[by][j] == code[i], by[j], hashing.all_probes))
        for i in range(len(q)):
            real = best[i] > -np.inf
            yield pa.record_batch([pa.array([i] * int(real.sum()), pa.int32()), pa.array(best[i][real]), pa.array(place[i][real], pa.int32())], names=["q", "score", "place"])

    found = classes.select("h1", "h2", "v").mapInArrow(run, "q int, score double, place int")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))).where(F.col("_r") <= k)
    return [None if r.place >= hashing.all_probes else r.place for r in first.collect()]  # sample x k rows at most


def calibrate(classes: DataFrame, asked: DataFrame, hashing: Polytopes, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> tuple[Polytopes, int]:
    """The hashing to use and its probes a table: as few as find the share of the sample's true neighbours, measured against all vectors.

    If no number of probes does, a table has one hash less; with one hash, all buckets can be probed, so some number always does.
    """
    some = asked.orderBy("h1", "h2").limit(sample).select("h1", "h2", "v").collect()
    q = matrix(pa.array([r.v for r in some], pa.list_(pa.float64())), hashing.dim)
    while True:
        places = sorted(hashing.all_probes if p is None else p for p in _nearest_exactly(classes, q, [(r.h1, r.h2) for r in some], hashing, k))
        need = places[math.ceil(recall * len(places)) - 1] + 1 if places else 1
        if need <= hashing.all_probes or hashing.hashes == 1:
            return hashing, min(need, hashing.all_probes)
        hashing = Polytopes(hashing.dim, hashing.longest, hashing.tables, hashing.hashes - 1, hashing.seed)


_PLACED = "t int, bucket bigint, h1 bigint, h2 bigint, v {v}, ids array<bigint>"


def _place(rows: DataFrame, hashing: Polytopes, probes: int) -> DataFrame:
    """A row for each table and bucket: the one that holds the vector, or with probes > 0 those that the query looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 65536 // max(probes, 1))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = matrix(part["v"], hashing.dim)
                for t in range(hashing.tables):
                    codes = hashing.probes(x, t, probes) if probes else hashing.buckets(x, t)[:, None]
                    at = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    yield pa.record_batch([pa.array(np.full(codes.size, t, np.int32)), pa.array(codes.ravel()), *(part[c].take(at) for c in ("h1", "h2", "v", "ids"))], names=["t", "bucket", "h1", "h2", "v", "ids"])

    return rows.select("h1", "h2", "v", "ids").mapInArrow(run, _PLACED.format(v=dict(rows.dtypes)["v"]))


def _rank(dim: int, k: int):
    """Compares the queries of each tile with its vectors. Rows of a tile come together, its vectors before its queries."""

    def best(q: pa.RecordBatch, x: np.ndarray, ids: list[list[int]]) -> tuple[list, list, list, list]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        y = matrix(q["v"], dim)
        score = y @ x.T
        most = min(k + 1, score.shape[1])
        # A class counts if it may be among the first k + 1 after sums are made in the one order.
        edge = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
        slack = np.nan_to_num(1e-9 * np.abs(score).max(1), nan=0, posinf=0)
        for i, (h1, h2) in enumerate(zip(q["h1"].to_pylist(), q["h2"].to_pylist(), strict=True)):
            near = np.flatnonzero(score[i] >= edge[i] - slack[i])
            exact = _products(np.broadcast_to(y[i], (len(near), dim)), x[near])
            found = sorted((-s, id_) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for id_ in ids[j])[: k + 1]
            for s, id_ in found:
                for a, v in zip(out, (h1, h2, id_, -s), strict=True):
                    a.append(v)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, ids, x = None, [], [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "bucket", "chunk", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if tile != tuple(keys[lo][:3]):
                    tile, parts, ids, x = tuple(keys[lo][:3]), [], [], None
                run_ = batch.slice(lo, hi - lo)
                if keys[lo][3] == 0:
                    parts.append(matrix(run_["v"], dim))
                    ids += run_["ids"].to_pylist()
                elif parts:
                    x = np.concatenate(parts) if x is None else x
                    for a in range(0, run_.num_rows, 512):
                        columns = best(run_.slice(a, 512), x, ids)
                        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["h1", "h2", "id", "score"])

    return run


def _search(classes: DataFrame, asked: DataFrame, hashing: Polytopes, probes: int, k: int, candidates: int) -> DataFrame:
    """(h1, h2, near): the k + 1 nearest (score, id) found of each asked vector, best first. One that finds fewer than there are looks into more buckets."""
    placed = _place(classes, hashing, 0)
    held = keep(placed.groupBy("t", "bucket").agg(F.count("*").alias("n")), "buckets")
    hot = bounded(held.where(F.col("n") > TILE).select("t", "bucket", F.ceil(F.col("n") / TILE).cast("int").alias("chunks")))
    index = placed.join(hot, ["t", "bucket"], "left").withColumn("chunk", F.coalesce(F.pmod(F.col("h1"), F.col("chunks")).cast("int"), F.lit(0)))
    looks = _place(asked, hashing, probes).join(hot, ["t", "bucket"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    columns = ["t", "bucket", "chunk", "kind", "h1", "h2", "v", "ids"]
    both = index.withColumn("kind", F.lit(0)).select(columns).unionByName(looks.withColumns({"kind": F.lit(1), "ids": F.lit(None).cast("array<bigint>")}).select(columns))
    met = both.repartition("t", "bucket", "chunk").sortWithinPartitions("t", "bucket", "chunk", "kind").mapInArrow(_rank(hashing.dim, k), "h1 bigint, h2 bigint, id bigint, score double")
    # A candidate of several tables has one score, so it has one rank; the limit by rank works before the shuffle too.
    ranked = met.withColumn("_r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= k + 1)
    near = keep(ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("less"), "id"))).alias("near")), "near")
    if hashing.hashes == 1 and probes >= hashing.axes:
        return near
    enough = near.where(F.size("near") >= min(k + 1, candidates))
    short = keep(asked.join(enough.select("h1", "h2"), ["h1", "h2"], "left_anti"), "short")
    if short.isEmpty():
        return near
    if probes < hashing.all_probes:
        more = _search(classes, short, hashing, min(4 * probes, hashing.all_probes), k, candidates)
    else:
        more = _search(classes, short, Polytopes(hashing.dim, hashing.longest, hashing.tables, hashing.hashes - 1, hashing.seed), probes, k, candidates)
    return enough.unionByName(more)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries(vec_id, embedding), rows of vectors too, the k nearest others found.

    Rows that are null, zero or hold a null or non-finite component, and rows without id, take no part. Rows with the query's id are its own.
    An id with several vectors is as near as the nearest of them; repeated rows count once. Shorter vectors count as filled up with zeros. Equal
    vectors are one class (told by 128 bits of hash) with as many ids as any query may return, so copies are neither paired nor moved; a bucket of
    many different vectors is dealt over tiles. Every vector is in the index; the number of probes is fitted on a bounded sample of queries whose
    neighbours are found exactly (``calibrate``). A query never returns fewer rows than there are: it probes on, up to all buckets.
    """
    spark = vectors.sparkSession
    hashed = lambda df: df.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").alias("v"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    rows = hashed(vectors)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    dim, longest = width(vectors), rows.agg(F.max(length)).first()[0]
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if longest is None:
        return spark.createDataFrame([], schema)
    classes = keep(_classes(rows, k), "classes")
    wanted = hashed(queries).select("vec_id", "h1", "h2").distinct()
    asked = keep(wanted.select("h1", "h2").distinct().join(classes, ["h1", "h2"]), "asked")
    n = classes.count()
    axes = Polytopes(dim, longest, tables, 1).axes
    hashes = max(1, math.ceil(math.log(max(n / BUCKET, 1)) / math.log(axes)))
    hashing, probes = calibrate(classes, asked, Polytopes(dim, longest, tables, hashes), k, recall)
    candidates = rows.select("vec_id").distinct().limit(k + 2).count()
    near = _search(classes, asked, hashing, probes, k, candidates)
    each = wanted.join(near, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.explode("near").alias("x")).where("x.id <> query_id")
    best = each.groupBy("query_id", F.col("x.id").alias("vec_id")).agg(F.max(-F.col("x.less")).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
