"""Event streams: envelope, exactly-once by sequence number, a bounded tail for late subscribers, latest state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events as ops

TAIL = 200
_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under path. Event time is a timestamp, as watermarks need."""
    raw = spark.readStream.schema(_SCHEMA).parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), F.col("event_type").alias("type"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("seq"))


def envelope(stream: DataFrame) -> DataFrame:
    return ops.normalise(stream.withColumns({"status": F.lit(None).cast("string"), "node": F.lit(None).cast("string"), "agent_id": F.concat(F.lit("agent-"), F.col("run_id") % 10)}))


def exactly_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Numbered events once a (run, seq) within the delay; unnumbered ones pass."""
    timed = stream.withWatermark("ts", delay)
    return timed.where("seq IS NOT NULL").dropDuplicatesWithinWatermark(["run_id", "seq"]).unionByName(timed.where("seq IS NULL"))


def windowed_counts(stream: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def tail(stream: DataFrame, size: int = TAIL) -> DataFrame:
    """(run_id, events): the ids of the newest events of each run, the oldest dropped beyond size. State is bounded by size a run."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = sorted({*held, *batch["event_id"].tolist()})[-size:]
        state.update((held,))
        yield pd.DataFrame({"run_id": [key[0]], "events": [held]})

    return stream.groupBy("run_id").applyInPandasWithState(keep, "run_id long, events array<long>", "held array<long>", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all there is and return what its memory table holds; for tests and replays of bounded size."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
