"""Revisioned records: proposals that name the revision they were made on, applied in order, with refusals, retries and undo; and logs that grow exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_proposals(current: DataFrame, proposals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, the order columns, status, revision, source): what becomes of each proposal.

    current(key, revision), proposals(key, order..., kind: put or undo, base, request, digest). A proposal counts if base is the revision that its record
    has when it comes: it is accepted and makes the next revision, else it is stale and changes nothing. A record that is not in current has revision 0.
    A request that came before with the same digest is repeated and has the outcome of the first, with another digest it is reused and refused;
    a null request is never a repetition. undo makes a new revision with what the one before the last held; below revision 2 of these proposals there is
    nothing to undo. source numbers the proposal (from 1, by order within its record) whose payload a revision holds.

    Repetitions are told apart by windows; the rest is a fold over proposals that Spark has sorted, whose state is one record's last two revisions.
    """
    columns = dict(proposals.dtypes)
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    same = Window.partitionBy(key, "request").orderBy("_n")
    # Requests are compared within a record; those without one are all firsts.
    rows = proposals.withColumn("_n", number.cast("bigint"))
    rows = rows.withColumns({"_first": F.when(F.col("request").isNull(), F.col("_n")).otherwise(F.first("_n").over(same)), "_digest": F.first("digest").over(same)})
    firsts = rows.where("_first = _n").join(current.select(key, F.col("revision").cast("bigint").alias("_at")), key, "left").select(key, "_n", "kind", F.col("base").cast("bigint").alias("base"), F.coalesce("_at", F.lit(0)).cast("bigint").alias("_at"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record, at, last, before = None, 0, 0, 0
        for batch in batches:
            out = []
            for k, n, kind, base, start in batch.itertuples(index=False):
                if k != record:
                    record, at, last, before = k, start, 0, 0
                if base != at:
                    out.append((k, n, "stale", at, None))
                elif kind == "undo" and not before:
                    out.append((k, n, "nothing_to_undo", at, None))
                else:
                    last, before = (before, last) if kind == "undo" else (n, last)
                    at += 1
                    out.append((k, n, "accepted", at, last))
            frame = pd.DataFrame(out, columns=[key, "_first", "status", "revision", "source"])
            yield frame.astype({"source": "Int64"})

    done = firsts.repartition(key).sortWithinPartitions(key, "_n").mapInPandas(fold, f"`{key}` {columns[key]}, _first bigint, status string, revision bigint, source bigint")
    met = rows.join(done, [key, "_first"])
    again, other = F.col("_n") > F.col("_first"), ~F.col("digest").eqNullSafe(F.col("_digest"))
    status = F.when(again & other, "reused").when(again, "repeated").otherwise(F.col("status"))
    return met.select(key, *order, status.alias("status"), "revision", F.when(~(again & other), F.col("source")).alias("source"))


def append_log(log: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a batch adds to a log: rows whose keys it does not have, each once, the first by order. Applied again, the same batch adds nothing."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_n", first).where("_n = 1").drop("_n").join(log.select(*keys), keys, "left_anti")


def log_snapshot(log: DataFrame, key: str, seq: str, since: int = 0) -> DataFrame:
    """(key, events, last, gap): of each run how many events its log holds after `since`, the last number, and the first that is missing; null if none is.

    A snapshot is made from the log alone, after the append, so that a run that failed in between is made good by the next one.
    """
    rows = log.where(F.col(seq) > since).select(key, F.col(seq).cast("bigint").alias("_s")).distinct()
    gap = F.when(F.col("_s") != F.coalesce(F.lag("_s").over(Window.partitionBy(key).orderBy("_s")), F.lit(since)) + 1, F.coalesce(F.lag("_s").over(Window.partitionBy(key).orderBy("_s")), F.lit(since)) + 1)
    return rows.withColumn("_g", gap).groupBy(key).agg(F.count("*").alias("events"), F.max("_s").alias("last"), F.min("_g").alias("gap"))
