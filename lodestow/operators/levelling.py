"""Schedules under limited resources: each plan by serial generation, by several rules of priority, checked by joins of their own."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schedule import resource_load

#: A plan has at most so many tasks; more are an error, as a plan is made in one task of Spark.
MAX_TASKS = 10_000


def _longest(after: list[list[tuple[int, int]]], first: list[int]) -> list[int]:
    """The longest path to each task over the links' weights."""
    waits = [0] * len(first)
    for links in after:
        for b, _ in links:
            waits[b] += 1
    at, ready, n = list(first), [k for k, w in enumerate(waits) if not w], 0
    while ready:
        k = ready.pop()
        n += 1
        for b, w in after[k]:
            if at[k] + w > at[b]:
                at[b] = at[k] + w
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    if n < len(first):
        raise ValueError("a plan's links go round in a circle")
    return at


def _following(n: int, links: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    after: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in links:
        after[a].append((b, w))
    return after


def _place(durations: list[int], after: list[list[tuple[int, int]]], waits: list[int], asks: list[list[tuple[int, int, int]] | None], digits: list[int], order: list[int], tail: list[int], most: float = math.inf) -> list[int | None] | None:
    """serial(), with the tasks in the order of their priority. asks: of each task (resource, units, what is left beside them), or None where it has no place.

    The load of a resource is held as the binary digits of its units, each digit of all days as one whole number. The result is None as soon as a start
    and the task's tail, what must follow its start, show that the schedule does not end before most.
    """
    n = len(durations)
    waits, early, asks = waits[:], [0] * n, asks[:]
    used = [[0] * x for x in digits]
    start: list[int | None] = [None] * n
    rank = [0] * n
    for i, k in enumerate(order):
        rank[k] = i
    ready = [rank[k] for k in range(n) if not waits[k]]
    heapq.heapify(ready)
    while ready:
        k = order[heapq.heappop(ready)]
        ask = asks[k]
        if ask is None:
            for b, _ in after[k]:
                asks[b] = None
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, rank[b])
            continue
        d, t = durations[k], early[k]
        if d > 0 and ask:
            full = 0
            for r, _, room in ask:
                over = 0
                for digit in used[r]:  # days with a load above the room, from the lowest digit on
                    over = over & digit if room & 1 else over | digit
                    room >>= 1
                full |= over >> t
            if full:
                s = 1
                while 2 * s <= d:
                    full |= full >> s
                    s *= 2
                full |= full >> d - s
                t += (~full & full + 1).bit_length() - 1
        if t + tail[k] >= most:
            return None
        if d > 0 and ask:
            days = (1 << d) - 1 << t
            for r, u, _ in ask:
                held, carry = used[r], 0
                for i, digit in enumerate(held):
                    if u & 1:
                        held[i] = digit ^ days ^ carry
                        carry = digit & days | carry & (digit ^ days)
                    elif carry:
                        held[i] = digit ^ carry
                        carry &= digit
                    elif not u:
                        break
                    u >>= 1
        start[k] = t
        for b, w in after[k]:
            if t + w > early[b]:
                early[b] = t + w
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, rank[b])
    return start


def _asked(needs: list[dict], capacity: dict) -> tuple[list[list[tuple[int, int, int]] | None], list[int]]:
    """(asks, digits) as _place() takes them."""
    at = {r: i for i, r in enumerate(capacity)}
    asks = [None if any(u > capacity.get(r, 0) for r, u in x.items()) else [(at[r], u, capacity[r] - u) for r, u in x.items() if u] for x in needs]
    return asks, [max(0, c).bit_length() for c in capacity.values()]


def _waits(n: int, links: list[tuple[int, int, int]]) -> list[int]:
    waits = [0] * n
    for _, b, _ in links:
        waits[b] += 1
    return waits


def serial(durations: list[int], links: list[tuple[int, int, int]], needs: list[dict], capacity: dict, priority: list[tuple]) -> list[int | None]:
    """A start for each task: of those whose predecessors have one, the first by priority takes its earliest place where no resource runs over.

    A task that asks for more than there is of a resource never has a place, nor have those after it: their start is None.
    """
    n = len(durations)
    return _place(durations, _following(n, links), _waits(n, links), *_asked(needs, capacity), sorted(range(n), key=priority.__getitem__), durations)


def _levelled(durations: list[int], arcs: list[tuple[int, int, int]], needs: list[dict], capacity: dict) -> tuple[list[int], list[int | None], str, int, int]:
    """(es, start, rule, bound, makespan) of one plan."""
    n = len(durations)
    after = _following(n, arcs)
    es = _longest(after, [0] * n)
    tail = _longest(_following(n, [(b, a, w) for a, b, w in arcs]), durations)
    path = max((e + t for e, t in zip(es, tail, strict=True)), default=0)
    (asks, digits), waits, work = _asked(needs, capacity), _waits(n, arcs), [0] * len(capacity)
    for d, ask in zip(durations, asks, strict=True):
        for r, u, _ in ask or ():
            work[r] += d * u
    follow = durations if None in asks else tail  # what waits for a task without a place never starts
    least = max([0, *(-(-w // c) for c, w in zip(capacity.values(), work, strict=True) if c)])
    rules = {
        "late_start": lambda: [path - t for t in tail], "work_after": lambda: [-d - t for d, t in zip(durations, tail, strict=True)],
        "longest": lambda: [(-d, -t) for d, t in zip(durations, tail, strict=True)], "early_start": lambda: [(e, -t) for e, t in zip(es, tail, strict=True)],
    }
    best, seen = None, []
    for name, priority in rules.items():
        order = sorted(range(n), key=priority().__getitem__)
        if order in seen:
            continue
        seen.append(order)
        start = _place(durations, after, waits, asks, digits, order, follow, best[3] if best else math.inf)
        if start is None:
            continue
        makespan = max((s + d for s, d in zip(start, durations, strict=True) if s is not None), default=0)
        bound = max([least, *(e + d for e, d, s in zip(es, durations, start, strict=True) if s is not None)])
        best = start, name, min(bound, makespan) if None in start else bound, makespan
        if best[3] <= best[2]:
            break
    return es, *best


def _values(column: pa.Array) -> list:
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def level(tasks: DataFrame, links: DataFrame, demands: DataFrame, capacities: DataFrame, plan: str = "plan") -> DataFrame:
    """(plan, id, duration, es, start, end, delay, rule, bound, makespan): each plan's tasks under its links and the capacities of resources.

    tasks(plan, id, duration), links(plan, before, after, weight: from start to start), demands(plan, id, resource, units), capacities(plan, resource,
    capacity). es is the start without limits, delay how much later it is. Of the rules (least late start, most work after it, longest, in the order of es)
    the one that ends first is kept. bound is what the longest path and each resource's work allow; makespan is never below it. A task whose demand
    no capacity meets, and those after it, have no start. Links to tasks that are not there are left out; a circle is an error. No heuristic proves that
    nothing is shorter: where makespan is the bound, it is the shortest.

    The four tables meet as rows of one, dealt by plan once; a task of Spark holds one plan and the rows of one batch.
    """
    kinds = dict(tasks.dtypes)
    of, resource = kinds["id"], dict(demands.dtypes)["resource"]
    none = lambda kind: F.lit(None).cast(kind)

    def part(rows: DataFrame, kind: int, key: Column, other: Column, what: Column, number: str) -> DataFrame:
        return rows.select(F.col(plan).cast(kinds[plan]).alias(plan), F.lit(kind).alias("kind"), key.cast(of).alias("id"), other.cast(of).alias("other"), what.cast(resource).alias("resource"), F.col(number).cast("int").alias("number"))

    rows = part(tasks, 0, F.col("id"), none(of), none(resource), "duration")
    rows = rows.union(part(links.dropna(subset=[plan, "before", "after"]), 1, F.col("after"), F.col("before"), none(resource), "weight"))
    rows = rows.union(part(demands.dropna(subset=[plan, "id"]).where("units > 0"), 2, F.col("id"), none(of), F.col("resource"), "units"))
    rows = rows.union(part(capacities.dropna(subset=[plan, "resource"]), 3, none(of), none(of), F.col("resource"), "capacity"))
    schema = f"{plan} {kinds[plan]}, id {of}, duration int, es int, start int, `end` int, delay int, rule string, bound int, makespan int"

    def run(out: list[list], plans: list, kind: list, ids: list, other: list, resource: list, number: list) -> None:
        n = bisect.bisect_left(kind, 1)
        if n > MAX_TASKS:
            raise ValueError(f"a plan has more than {MAX_TASKS} tasks")
        if not n:
            return
        at: dict = {i: [] for i in ids[:n]}
        for k, i in enumerate(ids[:n]):
            at[i].append(k)
        durations = [int(d) for d in number[:n]]
        first, last = bisect.bisect_left(kind, 2), bisect.bisect_left(kind, 3)
        arcs = [(at[a][-1], k, int(w)) for a, b, w in zip(other[n:first], ids[n:first], number[n:first], strict=True) if a in at for k in at.get(b, ())]
        known = {r: c or 0 for r, c in zip(resource[last:], number[last:], strict=True)}
        needs: list[dict] = [{} for _ in range(n)]
        for i, r, u in zip(ids[first:last], resource[first:last], number[first:last], strict=True):
            for k in at.get(i, ()):
                needs[k][r] = needs[k].get(r, 0) + u
        capacity = {r: known.get(r, 0) for x in needs for r in x}
        es, start, rule, bound, makespan = _levelled(durations, arcs, needs, capacity)
        ends = [None if s is None else s + d for s, d in zip(start, durations, strict=True)]
        late = [None if s is None else s - e for s, e in zip(start, es, strict=True)]
        for column, values in zip(out, (plans[:n], ids[:n], durations, es, start, ends, late, [rule] * n, [bound] * n, [makespan] * n), strict=True):
            column += values

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        out: list[list] = [[] for _ in range(10)]
        target = None
        for batch in batches:
            target = target or pa.schema([(plan, batch.schema.field(plan).type), ("id", batch.schema.field("id").type), *((c, pa.int32()) for c in ("duration", "es", "start", "end", "delay")), ("rule", pa.string()), ("bound", pa.int32()), ("makespan", pa.int32())])
            columns = [h + _values(c) for h, c in zip(held, batch.columns, strict=True)]
            p = columns[0]
            starts = [k for k in range(len(p)) if not k or p[k] is None or p[k] != p[k - 1]]
            for lo, hi in zip(starts, starts[1:], strict=False):
                run(out, *(c[lo:hi] for c in columns))
            held = [c[starts[-1] :] if starts else c for c in columns]
            if len(out[0]) > 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)
                out = [[] for _ in range(10)]
        if held[0]:
            run(out, *held)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    # A number of partitions of their own: few bytes are much work here, so small ones must not be put together.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, plan).sortWithinPartitions(plan, "kind", "id").mapInArrow(walk, schema)


def levelling_faults(levelled: DataFrame, links: DataFrame, demands: DataFrame, capacities: DataFrame, plan: str = "plan") -> DataFrame:
    """(plan, kind, what): links that a schedule breaks, resources that run over, plans shorter than their bound. A right schedule has no rows here."""
    starts = levelled.where("start IS NOT NULL").select(plan, "id", "start")
    pairs = links.join(starts.withColumnsRenamed({"id": "before", "start": "a"}), [plan, "before"]).join(starts.withColumnsRenamed({"id": "after", "start": "b"}), [plan, "after"])
    broken = pairs.where(F.col("b") < F.col("a") + F.col("weight")).select(plan, F.lit("link").alias("kind"), F.concat_ws(">", F.col("before").cast("string"), F.col("after").cast("string")).alias("what"))
    load = levelled.where("start IS NOT NULL AND duration > 0").join(demands, [plan, "id"]).withColumn("_r", F.struct(plan, "resource"))
    over = resource_load(load, "_r", "start", "end", "units").select("_r.*", "load").join(capacities, [plan, "resource"]).where("load > capacity").select(plan, F.lit("capacity"), F.col("resource").cast("string")).distinct()
    short = levelled.where("makespan < bound").select(plan, F.lit("bound"), F.col("makespan").cast("string")).distinct()
    return broken.union(over).union(short)
