"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 64
SHARDS = 40
SEED = 20240229
_CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Share of all words by weight; what is over cap times a source's size goes to the others by weight, until none is above."""
    want, left = share * sum(sizes), set(range(len(sizes)))
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    while left:
        total = sum(weight[k] for k in left)
        over = [k for k in left if want * weight[k] / total >= cap * sizes[k]]
        if not over:
            for k in left:
                out[k] = want * weight[k] / total
            break
        for k in over:
            out[k] = float(cap * sizes[k])
        want -= sum(out[k] for k in over)
        left -= set(over)
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats to the highest quotients v / 1, v / 3, v / 5, ...; equal quotients to the earlier. Takes no time for each seat."""
    v = np.asarray(votes, dtype=np.float64)
    if not v.any() or not seats:
        return [0] * len(votes)

    def at(x: float) -> np.ndarray:  # seats whose quotient is x or more
        return ((v / x + 1) // 2).astype(np.int64)

    low, high = v.sum() / (2 * seats + len(v) + 1) / 4, 2 * v.max()
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    won = at(high)
    while won.sum() < seats:  # equal quotients at the edge
        won[np.argmax(v / (2 * won + 1))] += 1
    return won.tolist()


def quotas(target: list[float], seats: int, shards: int) -> list[list[int]]:
    """Seats of each source up to and with each shard. More seats never take one from a source, so differences are quotas."""
    return [sainte_lague(target, seats * (k + 1) // shards) for k in range(shards)]


def _step(n: int) -> int:
    """A step without a common divisor with n, so that step * x mod n is a permutation; step * n fits in 63 bits."""
    a = max(1, min(int(n * 0.6180339887498949), (1 << 62) // max(n, 1))) | 1
    while math.gcd(a, n) != 1:
        a += 2
    return a % n if n > 1 else 0


def mix_plan(sizes: list[tuple[str | None, int]], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, share: float = SHARE, cap: float = CAP) -> pd.DataFrame:
    """One row a source: its target, how often the whole source is taken, and how many blocks are taken once more.

    Block x of n has rank (step * x + start) mod n, an even seeded order in which every block has its own rank. The source's
    seats are filled by rank, once for each time the whole source is taken, then with the first ranks once more.
    seats[k] is how many of them lie in shards 0 to k, so each shard holds its quota of blocks of each source.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8", "surrogatepass")))
    size = [n for _, n in order]
    goal = targets(size, share, cap)
    seats = quotas(goal, round(sum(goal) / block), shards)
    rows = []
    for k, (source, n) in enumerate(order):
        blocks = -(-n // block)
        # No document is taken more than cap times: a seat beyond that stays empty (the last block of a source may be short).
        won = min(seats[-1][k], int(cap * blocks))
        start = (seed * 7919 + k * 104729) % blocks if blocks else 0
        rows.append((source, n, goal[k], blocks, won // blocks if blocks else 0, won % blocks if blocks else 0, _step(blocks) if blocks else 0, start, block, [s[k] for s in seats]))
    return pd.DataFrame(rows, columns=["m_source", "source_size", "target", "blocks", "whole", "rest", "step", "start", "block", "seats"])


_PLAN = "m_source string, source_size bigint, target double, blocks bigint, whole bigint, rest bigint, step bigint, start bigint, block bigint, seats array<bigint>"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, m_source, size, source_size, target, taken, whole, picks, parts): what the mix takes of each row.

    taken = whole * size + the words of the row that lie in blocks taken once more; picks lists those as word ranges
    [a, b) of the row. parts lists all that is taken, of whole passes too: the range [a, b), the block x of the source that it
    lies in, and the shard that the block goes to by the quotas of the shards. Documents lie in each source in the order of a
    seeded hash of their id.

    Null text or a text of white space: size 0, taken 0. A null source is a source, the last. Rows that repeat an id
    are documents of their own. Empty table: no rows.
    """
    spark = docs.sparkSession
    seed = options.get("seed", SEED)
    lean = docs.select(F.col(id_col).alias("m_id"), F.col(source_col).cast("string").alias("m_source"), word_count(F.col(text_col)).alias("size"))
    lean = keep(lean.withColumn("m_key", F.xxhash64(F.lit(seed), "m_id")).withColumn("m_cell", F.pmod("m_key", F.lit(_CELLS))), "sizes")
    # A hot source is dealt over cells: words before a row = words of earlier cells + words before it in its own.
    cells = lean.groupBy("m_source", "m_cell").agg(F.sum("size").alias("words"))
    cells = keep(cells.select("m_source", "m_cell", (F.sum("words").over(Window.partitionBy("m_source").orderBy("m_cell")) - F.col("words")).alias("m_before"), "words"), "cells")
    totals = [(r[0], r[1]) for r in cells.groupBy("m_source").agg(F.sum("words")).collect()]  # a row for each source
    plan = spark.createDataFrame(mix_plan(totals, **options).to_dict("split")["data"], _PLAN)
    inside = Window.partitionBy("m_source", "m_cell").orderBy("m_key", "m_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a["m_source"].eqNullSafe(b["m_source"])
    rows = lean.withColumn("m_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(cells.drop("words").withColumnsRenamed({"m_source": "c_source", "m_cell": "c_cell"}), F.col("m_source").eqNullSafe(F.col("c_source")) & (F.col("m_cell") == F.col("c_cell"))).drop("c_source", "c_cell")
    rows = rows.join(plan.withColumnRenamed("m_source", "p_source"), F.col("m_source").eqNullSafe(F.col("p_source"))).drop("p_source")
    rows = rows.withColumn("m_from", F.col("m_before") + F.col("m_inside"))
    spans = F.expr(
        """CASE WHEN size > 0 THEN transform(sequence(m_from DIV block, (m_from + size - 1) DIV block),
             x -> struct(greatest(x * block - m_from, 0) AS a, least((x + 1) * block - m_from, size) AS b, x AS x, (step * x + start) % blocks AS r))
           ELSE cast(array() AS array<struct<a: bigint, b: bigint, x: bigint, r: bigint>>) END"""
    )
    rows = rows.withColumn("spans", spans).withColumn("picks", F.expr("filter(spans, p -> p.r < rest)"))
    # Pass k of a block of rank r fills seat k * blocks + r of its source; the shard is the first whose seats reach beyond it.
    parts = """flatten(transform(spans, p -> transform(sequence(1, int(whole) + int(p.r < rest)), k ->
        struct(p.a AS a, p.b AS b, p.x AS x, size(filter(seats, s -> s <= (k - 1) * blocks + p.r)) AS shard))))"""
    none = "cast(array() AS array<struct<a: bigint, b: bigint, x: bigint, shard: int>>)"
    rows = rows.withColumn("parts", F.expr(f"CASE WHEN whole > 0 THEN {parts} WHEN size(picks) > 0 THEN {parts.replace('spans', 'picks', 1)} ELSE {none} END"))
    taken = F.col("whole") * F.col("size") + F.expr("aggregate(picks, 0L, (s, p) -> s + p.b - p.a)")
    return rows.select(F.col("m_id").alias(id_col), "m_source", "size", "source_size", "target", taken.alias("taken"), "whole", "picks", "parts")


def op9_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest, and the words that each shard gets of each row, as shard:words by shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = "aggregate(filter(parts, p -> p.shard = s), 0L, (n, p) -> n + p.b - p.a)"
    shards = F.expr(f"array_join(transform(array_sort(array_distinct(transform(parts, p -> p.shard))), s -> concat(s, ':', {words})), ',')")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))
