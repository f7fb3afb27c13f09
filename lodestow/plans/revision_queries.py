"""Revisioned records and logs over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import revisions
from .tables import table


def _proposals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as proposals to their customer's record: some undo, some made on an old revision, some sent again."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (at - 1).cast("bigint").alias("n"))
    kind = F.when(F.col("o_orderkey") % 5 == 0, "undo").otherwise("put")
    base = F.col("o_custkey") % 3 + F.greatest(F.lit(0), F.col("n") - F.floor(F.col("n") / 4) - F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    request = F.when(F.col("o_orderkey") % 11 > 1, F.col("n") - F.when(F.col("o_orderkey") % 4 == 1, 1).otherwise(0))
    proposals = rows.select("o_custkey", "o_orderkey", kind.alias("kind"), base.cast("bigint").alias("base"), request.alias("request"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("digest"))
    current = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3).cast("bigint").alias("revision"))
    return current, proposals


def revision_apply(spark: SparkSession, d: str) -> DataFrame:
    current, proposals = _proposals(spark, d)
    return revisions.apply_proposals(current, proposals, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "status", "revision", F.coalesce("source", F.lit(0)).alias("source"))


def log_append_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Lines of half the orders as a log, all lines twice as a batch: the log after it, a number a line, with what is missing."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("seq"), "l_partkey", "l_suppkey")
    log = revisions.append_log(lines.limit(0), lines.where("l_orderkey % 2 = 0"), ["l_orderkey", "seq"], ["l_partkey", "l_suppkey"])
    added = revisions.append_log(log, lines.unionByName(lines), ["l_orderkey", "seq"], ["l_partkey", "l_suppkey"])
    return revisions.log_snapshot(log.unionByName(added), "l_orderkey", "seq").select("l_orderkey", "events", "last", F.coalesce("gap", F.lit(0)).alias("gap"))


QUERIES = {f.__name__: f for f in (revision_apply, log_append_snapshot)}

#: One step a proposal: the record's revision, and what it and the one before hold, are carried from row to row.
SQL = {
    "revision_apply": """WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
      p AS (SELECT o_custkey AS c, o_orderkey AS k, n, CASE WHEN o_orderkey % 5 = 0 THEN 'undo' ELSE 'put' END AS kind, o_custkey % 3 + greatest(0, (n - 1) - (n - 1) // 4 - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS base,
        CASE WHEN o_orderkey % 11 > 1 THEN (n - 1) - CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END END AS q, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS digest FROM r),
      f AS (SELECT *, CASE WHEN q IS NULL THEN n ELSE min(n) OVER (PARTITION BY c, q) END AS fn FROM p),
      g AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n) AS i FROM f WHERE fn = n),
      w AS (SELECT o_custkey AS c, 0::BIGINT AS i, 0::BIGINT AS n, '' AS status, CASE WHEN any_value(c_custkey) IS NULL THEN 0 ELSE o_custkey % 3 END AS at, 0::BIGINT AS last, 0::BIGINT AS before, 0::BIGINT AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0 GROUP BY 1
        UNION ALL SELECT w.c, g.i, g.n, CASE WHEN g.base <> w.at THEN 'stale' WHEN g.kind = 'undo' AND w.before = 0 THEN 'nothing_to_undo' ELSE 'accepted' END, CASE WHEN g.base <> w.at OR (g.kind = 'undo' AND w.before = 0) THEN w.at ELSE w.at + 1 END,
          CASE WHEN g.base <> w.at OR (g.kind = 'undo' AND w.before = 0) THEN w.last WHEN g.kind = 'undo' THEN w.before ELSE g.n END, CASE WHEN g.base <> w.at OR (g.kind = 'undo' AND w.before = 0) THEN w.before ELSE w.last END,
          CASE WHEN g.base <> w.at OR (g.kind = 'undo' AND w.before = 0) THEN 0 WHEN g.kind = 'undo' THEN w.before ELSE g.n END FROM w JOIN g ON g.c = w.c AND g.i = w.i + 1)
      SELECT f.c AS o_custkey, f.k AS o_orderkey, CASE WHEN f.n > f.fn THEN CASE WHEN f.digest <> a.digest THEN 'reused' ELSE 'repeated' END ELSE w.status END AS status, CAST(w.at AS BIGINT) AS revision, CASE WHEN f.n > f.fn AND f.digest <> a.digest THEN 0 ELSE w.source END AS source
      FROM f JOIN w ON w.c = f.c AND w.n = f.fn AND w.i > 0 JOIN f a ON a.c = f.c AND a.n = f.fn""",
    "log_append_snapshot": """WITH s AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS q FROM lineitem), g AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY l_orderkey ORDER BY q), 0) AS b FROM s WHERE q > 0)
      SELECT l_orderkey, count(*) AS events, max(q) AS last, coalesce(min(CASE WHEN q <> b + 1 THEN b + 1 END), 0) AS gap FROM g GROUP BY 1""",
}
