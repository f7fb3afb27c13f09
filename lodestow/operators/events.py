"""Event logs and keyed tables: dedupe, merge, replay, retention, latest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with changes merged in: the row of the highest version of each key stays, of equal versions the change."""
    both = base.withColumn("_s", F.lit(1)).unionByName(changes.withColumn("_s", F.lit(0)))
    return first_per(both, keys, F.desc(version), "_s").drop("_s")


def merge_events(primary: DataFrame, fallback: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Numbered events: one a (run, seq), the primary source's if it has it. Unnumbered ones: as often as the source that holds them most often."""
    n = int(primary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of runs are small once compressed: partitions of their own are not put together into ones that fill a task's memory.
    both = primary.withColumn("_s", F.lit(0)).unionByName(fallback.withColumn("_s", F.lit(1))).repartition(n, run)
    others = [c for c in primary.columns if c != seq]
    numbered = first_per(both.where(F.col(seq).isNotNull()), [run, seq], "_s", *(c for c in others if c != run)).drop("_s")
    times = both.where(F.col(seq).isNull()).groupBy("_s", *others).agg(F.count("*").alias("_n")).groupBy(*others).agg(F.max("_n").alias("_n"))
    unnumbered = times.select(*others, F.lit(None).cast(dict(primary.dtypes)[seq]).alias(seq), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_n")).drop("_n")
    return numbered.unionByName(unnumbered)


def prune(runs: DataFrame, cutoff: Column, keep: int, session: str = "session_id", started: str = "started_at", run: str = "run_id") -> DataFrame:
    """runs with archived: old runs go oldest first while their session holds keep runs or more; old runs of no session go."""
    by = Window.partitionBy(session)
    nth = F.row_number().over(by.orderBy(F.coalesce(F.col(started).cast("string"), F.lit("")), run))
    old = F.coalesce(F.col(started) < cutoff, F.lit(True))
    return runs.withColumn("archived", old & (F.col(session).isNull() | (nth <= F.count("*").over(by) - keep + 1)))


def stale(sessions: DataFrame, events: DataFrame, settled: str = "done") -> DataFrame:
    """Sessions without a settling event of their run at or after their save."""
    done = events.where(F.col("type") == settled).groupBy("run_id").agg(F.max("ts").alias("_last"))  # one row a run: the latest decides
    return sessions.join(done, "run_id", "left").where("_last IS NULL OR _last < saved_at").drop("_last")


def replay(events: DataFrame, run_id: object, after: int = 0, limit: int = 1000) -> DataFrame:
    """Keyset page of one run's events."""
    return events.where((F.col("run_id") == run_id) & (F.col("seq") > after)).orderBy("seq").limit(limit)


def normalise(events: DataFrame) -> DataFrame:
    """Envelope of an event on a batch or a stream: node and agent stand in for each other, status follows the type."""
    status = F.coalesce("status", F.when(F.col("type").isin("error", "failed"), "error").when(F.col("type").isin("done", "purchase"), "ok").otherwise("running"))
    return events.withColumn("status", status).withColumn("node", F.coalesce("node", "agent_id")).withColumn("agent_id", F.coalesce("agent_id", "node"))


def revisions(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Values of a field over time: repeats merged, the newest active, older ones superseded by the next."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = rows.withColumn("_p", F.lag(text).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(text))).drop("_p")
    return changed.withColumn("superseded_by", F.lead(order).over(w)).withColumn("state", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))
