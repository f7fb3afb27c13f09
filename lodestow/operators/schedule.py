"""Working calendars, critical paths, resource load, roll-ups and shortest routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import use_checkpoints


def workdays(spans: DataFrame, holidays: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, day, offset): Mondays to Fridays between start and end that are no holidays, counted from 0."""
    keys = [c for c in spans.columns if c not in (start, end)]
    days = spans.select(*keys, F.explode(F.sequence(start, end)).alias("day")).where(F.weekday("day") < 5).join(holidays, "day", "left_anti")
    return days.withColumn("offset", F.row_number().over(Window.partitionBy(*keys).orderBy("day")) - 1)


def resource_load(demands: DataFrame, resource: str = "resource", start: str = "start", end: str = "end", units: str = "units") -> DataFrame:
    """(resource, from, to, load) between neighbouring event points, by a running sum of what starts and ends there."""
    points = demands.select(resource, F.col(start).alias("at"), F.col(units).alias("d")).unionByName(demands.select(resource, F.col(end).alias("at"), (-F.col(units)).alias("d")))
    points = points.groupBy(resource, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(resource).orderBy("at")
    loads = points.withColumn("load", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(w))
    return loads.where("to IS NOT NULL").select(resource, F.col("at").alias("from"), "to", "load")


def _fixpoint(state: DataFrame, step, value: str) -> DataFrame:
    """Repeat step until no value changes; lineage is cut with checkpoint() in the session's checkpoint folder.

    Steps join by shuffles ("merge"): a side that is small enough to be sent would go through the driver in each round.

    A path without a cycle has fewer links than there are rows, so a change after that many steps means a cycle.
    """
    use_checkpoints(state.sparkSession)
    state = state.checkpoint()
    most = state.count()
    seen = state.agg(F.sum(F.col(value).cast("decimal(38,6)")), F.count(value)).first()
    for _ in range(most + 1):
        state = step(state).checkpoint()
        now = state.agg(F.sum(F.col(value).cast("decimal(38,6)")), F.count(value)).first()
        if now == seen:
            return state
        seen = now
    raise ValueError("no fixed point: the graph has a cycle")


def earliest_starts(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """tasks(id, duration) with es, the longest path of links(before, after, lag) that leads to them. A level a step; a cycle is an error."""

    def step(state: DataFrame) -> DataFrame:
        reach = links.join(state.select(F.col("id").alias("before"), (F.col("es") + F.col("duration")).alias("ends")).hint("merge"), "before").groupBy(F.col("after").alias("id")).agg(F.max(F.col("ends") + F.col("lag")).alias("need"))
        return state.join(reach.hint("merge"), "id", "left").select("id", "duration", F.greatest("es", F.coalesce("need", F.lit(0))).alias("es"))

    return _fixpoint(tasks.withColumn("es", F.lit(0).cast("bigint")), step, "es")


def critical_path(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """es, ls, slack and critical of each task: the backward pass is the forward pass over reversed links."""
    forward = earliest_starts(tasks, links)
    end = forward.agg(F.max(F.col("es") + F.col("duration")).alias("makespan"))
    back = earliest_starts(tasks, links.select(F.col("after").alias("before"), F.col("before").alias("after"), "lag")).select("id", F.col("es").alias("tail"))
    both = forward.join(back.hint("merge"), "id").crossJoin(F.broadcast(end))  # one row
    ls = F.col("makespan") - F.col("tail") - F.col("duration")
    return both.select("id", "duration", "es", ls.alias("ls"), (ls - F.col("es")).alias("slack"), (ls == F.col("es")).alias("critical"))


def shortest_routes(edges: DataFrame, origin: object) -> DataFrame:
    """(node, distance) from origin over edges(from, to, weight), by repeated relaxation of the whole frontier."""
    nodes = edges.select(F.col("from").alias("node")).unionByName(edges.select(F.col("to").alias("node"))).distinct()
    start = nodes.withColumn("distance", F.when(F.col("node") == origin, F.lit(0)).cast("bigint"))

    def step(state: DataFrame) -> DataFrame:
        reach = edges.join(state.where("distance IS NOT NULL").select(F.col("node").alias("from"), "distance").hint("merge"), "from").groupBy(F.col("to").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("d"))
        return state.join(reach.hint("merge"), "node", "left").select("node", F.least("distance", "d").alias("distance"))

    return _fixpoint(start, step, "distance")


def link_weights(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """links(before, after, kind, lag) of any kind as links that say how long after the start of before the start of after may be.

    kind is two letters: F or S, the end or start of before that counts, and the end or start of after that waits for it.
    """
    durations = tasks.select("id", "duration")
    both = links.join(durations.withColumnsRenamed({"id": "before", "duration": "_b"}).hint("merge"), "before").join(durations.withColumnsRenamed({"id": "after", "duration": "_a"}).hint("merge"), "after")
    weight = F.col("lag") + F.when(F.col("kind").startswith("F"), F.col("_b")).otherwise(0) - F.when(F.col("kind").endswith("F"), F.col("_a")).otherwise(0)
    return both.select("before", "after", weight.alias("weight"))


def schedule(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """(id, duration, es, ls, slack, critical) under links of the kinds FS, SS, FF and SF with lags.

    Starts are the longest path over the weights of the links, 0 at least; late starts the same path backwards from the end of the plan.
    """
    weights = link_weights(tasks, links)

    def longest(w: DataFrame, start: DataFrame) -> DataFrame:
        def step(state: DataFrame) -> DataFrame:
            reach = w.join(state.select(F.col("id").alias("before"), "at").hint("merge"), "before").groupBy(F.col("after").alias("id")).agg(F.max(F.col("at") + F.col("weight")).alias("need"))
            return state.join(reach.hint("merge"), "id", "left").select("id", "duration", F.greatest("at", "need").alias("at"))

        return _fixpoint(start, step, "at")

    forward = longest(weights, tasks.select("id", "duration", F.lit(0).cast("bigint").alias("at"))).withColumnRenamed("at", "es")
    end = forward.agg(F.max(F.col("es") + F.col("duration")).alias("makespan"))
    back = weights.select(F.col("after").alias("before"), F.col("before").alias("after"), "weight")
    tails = longest(back, tasks.select("id", "duration", F.col("duration").cast("bigint").alias("at"))).select("id", F.col("at").alias("tail"))
    both = forward.join(tails.hint("merge"), "id").crossJoin(F.broadcast(end))  # one row
    ls = F.col("makespan") - F.col("tail")
    return both.select("id", "duration", "es", ls.alias("ls"), (ls - F.col("es")).alias("slack"), (ls == F.col("es")).alias("critical"))


def compare_baseline(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(id, status, days): tasks added, removed or in both plans, and by how many calendar days the end moved. Plans are (id, start, end)."""
    both = baseline.select("id", F.col("end").alias("was")).join(current.select("id", F.col("end").alias("now")), "id", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("existing")
    return both.select("id", status.alias("status"), F.date_diff("now", "was").alias("days"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of a work breakdown parents(id, parent), by doubling: a round sends the paths of exactly 2^k levels on by what is above their ends.

    In a tree each pair comes up once. Where a task has several parents the shortest way counts. A task that is its own ancestor is an error.
    """
    use_checkpoints(parents.sparkSession)
    piece = closure = parents.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)).checkpoint()
    tree = closure.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    span = 1
    while not piece.isEmpty():
        if not piece.where("id = ancestor").isEmpty():
            raise ValueError("a task is its own ancestor")
        up = closure.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("depth").alias("_more"))
        longer = piece.where(F.col("depth") == span).select("id", "ancestor").join(up.hint("merge"), "ancestor").select("id", F.col("_next").alias("ancestor"), (F.col("_more") + span).alias("depth"))
        if not tree:
            longer = longer.groupBy("id", "ancestor").agg(F.min("depth").alias("depth")).join(closure.select("id", "ancestor").hint("merge"), ["id", "ancestor"], "left_anti")
        piece = longer.checkpoint()
        closure, span = closure.unionByName(piece), span * 2
    return closure
