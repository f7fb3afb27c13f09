"""Keyed tables of runs, sessions, turns and documents: what each write leaves behind, as a new table."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import first_per


def use_checkpoints(spark: SparkSession) -> None:
    """The session's checkpoint folder; only where none is named (tests), one of our own."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestow-"))


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that what reads it twice does not run it twice and a lost executor loses nothing."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with those rows whose key it lacks; of new rows with one key the first by order."""
    return base.unionByName(first_per(rows, keys, order).join(base.select(*keys), keys, "left_anti"))


def with_placeholders(sessions: DataFrame, runs: DataFrame, key: str = "session_id") -> DataFrame:
    """sessions with a placeholder for each session that a run names and that is not there."""
    lacking = runs.where(F.col(key).isNotNull()).select(key).distinct().join(sessions.select(key), key, "left_anti")
    return sessions.unionByName(lacking.withColumn("status", F.lit("placeholder")), allowMissingColumns=True)


def replace_documents(chunks: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """chunks in which all rows of each document that changed names are those of changed: old ones go, however many there were."""
    return chunks.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(changed)


def delete_documents(chunks: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.join(gone.select(*keys).distinct(), keys, "left_anti")


def interrupt_orphans(runs: DataFrame, events: DataFrame, phases: list[str], settled: list[str], ended_at: Column) -> DataFrame:
    """runs in which those that are neither archived nor ended, in a running phase and without a settling event are interrupted."""
    done = events.where(F.col("type").isin(settled)).select("run_id").distinct().withColumn("_done", F.lit(True))
    phase, status = F.coalesce("phase", F.lit("")), F.coalesce("status", F.lit(""))
    orphan = ~F.col("archived") & phase.isin(["", *phases]) & status.isin("", "running", "resumed") & F.col("_done").isNull()
    marked = runs.join(done, "run_id", "left").withColumn("_orphan", orphan)
    out = marked.withColumn("phase", F.when(F.col("_orphan"), "interrupted").otherwise(F.col("phase")))
    out = out.withColumn("status", F.when(F.col("_orphan"), "aborted").otherwise(F.col("status")))
    return out.withColumn("ended_at", F.when(F.col("_orphan"), F.coalesce("ended_at", ended_at)).otherwise(F.col("ended_at"))).drop("_done", "_orphan")


def remember(keys: DataFrame, puts: DataFrame, expire_before: Column, created: str = "created_at") -> DataFrame:
    """Idempotency keys (scope, key, ...) after puts: entries from before the bound go, of one key the latest put stays."""
    alive = keys.where(F.col(created) >= expire_before).withColumn("_s", F.lit(1)).unionByName(puts.withColumn("_s", F.lit(0)))
    return first_per(alive, ["scope", "key"], "_s", F.desc(created)).drop("_s")


def start_turns(requests: DataFrame, keys: DataFrame, turns: DataFrame) -> DataFrame:
    """requests(workspace_id, session_id, key, sha) with outcome and turn_id: a known key gives its turn back, or a conflict if it was used
    for another session or request; else a session with a running turn is busy, and the others start. keys(workspace_id, key, session_id, sha, turn_id)."""
    known = keys.select("workspace_id", "key", F.col("session_id").alias("_session"), F.col("sha").alias("_sha"), "turn_id")
    busy = turns.where(F.col("status").isin("running", "cancelling")).select("workspace_id", "session_id").distinct().withColumn("_busy", F.lit(True))
    met = requests.join(known, ["workspace_id", "key"], "left").join(busy, ["workspace_id", "session_id"], "left")
    same = (F.col("_session") == F.col("session_id")) & (F.col("_sha") == F.col("sha"))
    outcome = F.when(F.col("_sha").isNotNull(), F.when(same, "existing").otherwise("conflict")).when(F.col("_busy"), "busy").otherwise("started")
    return met.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "existing", F.col("turn_id")).alias("turn_id"))
