"""Crates and levelled schedules against checks of their own."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestow.operators import crating, levelling

ROWS = "s long, row long, l int, w int, h int, qty int, total_kg double"


def test_crates_hold_everything_within_their_limits(spark):
    rng = random.Random(4)
    rows = [(k % 3, k, rng.randrange(200, 6500), rng.randrange(20, 1000), rng.randrange(20, 1000), rng.randrange(1, 30), rng.uniform(1, 3000)) for k in range(150)]
    rows += [(0, 900, 1000, 100, 100, 3, 30000.0), (0, 901, 9000, 2000, 2000, 1, 10.0), (1, 902, 500, 100, 100, None, None), (1, 903, 500, 100, 100, 0, 7.0)]
    df = spark.createDataFrame(rows, ROWS)
    built = crating.build_crates(df, "s", "row").cache()
    assert crating.crate_faults(built, df, "s", "row").collect() == []
    assert built.select("s", "crate_no").distinct().count() < built.count()
    caps = {r.row: r.cap for r in df.select("row", crating.net_cap(F.col("l")).alias("cap")).collect()}
    for r in built.groupBy("s", "crate_no").agg(F.sum("net_kg").alias("kg"), F.collect_set("row").alias("rows"), F.first("crate_net_kg").alias("said")).collect():
        assert r.kg <= min(caps[k] for k in r.rows) + 1e-6 and r.said == pytest.approx(r.kg, abs=0.002)
    assert crating.build_crates(df.limit(0), "s", "row").count() == 0


def test_faults_of_crates_are_seen(spark):
    rows = spark.createDataFrame([(1, 1, 500, 100, 100, 4, 40.0), (1, 2, 500, 100, 100, 1, 5000.0)], ROWS)
    built = spark.createDataFrame([(1, 1, 3, 30.0, 1, "cage", 2000.0), (1, 2, None, 2500.0, 1, "cage", 2000.0), (1, 2, None, 2500.0, 2, "cage", 9000.0), (1, 1, None, 0.0, 2, "cage", 9000.0)], "s long, row long, pieces int, net_kg double, crate_no long, crate_type string, outer_l double")
    assert {tuple(r) for r in crating.crate_faults(built, rows, "s", "row").collect()} == {(1, "not_conserved", "1"), (1, "payload", "1"), (1, "payload", "2"), (1, "too_long", "2")}


def test_rules_of_rows(spark):
    df = spark.createDataFrame([(1000, 500, 60, 9.0, 99), (3000, 1100, 10, 30.0, 99), (6000, 100, 100, 30.0, 99), (3600, 200, 200, 1.0, 99), (500, 90, 90, 0.0, 99)], "l int, w int, h int, kg double, q int")
    got = [tuple(r) for r in df.select(crating.most_pieces(*(F.col(c) for c in ("l", "w", "h", "kg", "q")), crating.net_cap(F.col("l"))), crating.net_cap(F.col("l")), crating.length_band(F.col("l"))).collect()]
    assert got == [(33, 3200, "1m"), (12, 400, "3m"), (9, 480, "6m"), (12, 560, "4m"), (48, 3200, "1m")]
    picked = spark.createDataFrame([(900, 500, 500, 100.0), (900, 500, 500, 1500.0), (1900, 500, 500, 1.0), (4700, 500, 500, 1.0), (7000, 500, 500, 1.0), (100, 3000, 3000, 1.0), (2600, 900, 1600, 1.0)], "l int, w int, h int, kg double")
    assert [r[0] for r in picked.select(crating.crate_type(*(F.col(c) for c in ("l", "w", "h", "kg")))).collect()] == ["1.1m frame", "cage", "2m frame", "6m frame", "6m frame", "6m frame", "4m frame"]


TASKS, LINKS, DEMANDS, CAPS = "plan long, id long, duration int", "plan long, before long, after long, weight int", "plan long, id long, resource string, units int", "plan long, resource string, capacity int"


def frames(spark, tasks, links, demands, caps):
    return [spark.createDataFrame(rows, schema) for rows, schema in zip((tasks, links, demands, caps), (TASKS, LINKS, DEMANDS, CAPS), strict=True)]


def test_small_plans_are_as_short_as_any_order_allows(spark):
    rng = random.Random(2)
    tasks, links, demands, caps, best = [], [], [], [], {}
    for plan in range(6):
        d = [rng.randrange(0, 5) for _ in range(6)]
        arcs = [(a, b, d[a] + rng.randrange(0, 2)) for a, b in itertools.combinations(range(6), 2) if rng.random() < 0.3]
        needs = [{"r": rng.randrange(1, 4)} for _ in range(6)]
        tasks += [(plan, k, x) for k, x in enumerate(d)]
        links += [(plan, *a) for a in arcs]
        demands += [(plan, k, "r", n["r"]) for k, n in enumerate(needs)]
        caps.append((plan, "r", 4))
        # serial generation over all orders holds a shortest schedule
        ends = []
        for order in itertools.permutations(range(6)):
            start = levelling.serial(d, arcs, needs, {"r": 4}, [(order.index(k),) for k in range(6)])
            ends.append(max(s + x for s, x in zip(start, d, strict=True)))
        best[plan] = min(ends)
    found = levelling.level(*frames(spark, tasks, links, demands, caps)).cache()
    assert levelling.levelling_faults(found, *frames(spark, tasks, links, demands, caps)[1:]).collect() == []
    got = {r.plan: (r.makespan, r.bound) for r in found.select("plan", "makespan", "bound").distinct().collect()}
    assert all(best[p] <= m <= best[p] + 2 and b <= best[p] for p, (m, b) in got.items())
    assert sum(m == best[p] for p, (m, _) in got.items()) >= 4


def test_what_can_not_be_scheduled(spark):
    tasks, links, demands, caps = frames(spark, [(1, 1, 3), (1, 2, 2), (1, 3, 1), (1, 4, 0), (2, 1, 5)], [(1, 1, 2, 3), (1, 2, 3, 2), (1, 99, 1, 7)], [(1, 2, "r", 9), (1, 1, "r", 1), (2, 1, "none", 1)], [(1, "r", 5)])
    got = {(r.plan, r.id): (r.es, r.start, r.end, r.delay) for r in levelling.level(tasks, links, demands, caps).collect()}
    assert got == {(1, 1): (0, 0, 3, 0), (1, 2): (3, None, None, None), (1, 3): (5, None, None, None), (1, 4): (0, 0, 0, 0), (2, 1): (0, None, None, None)}
    with pytest.raises(Exception, match="circle"):
        levelling.level(tasks, links.unionByName(spark.createDataFrame([(1, 3, 1, 0)], LINKS)), demands, caps).collect()
    assert levelling.level(tasks.limit(0), links, demands, caps).count() == 0


def test_broken_schedules_are_seen(spark):
    levelled = spark.createDataFrame([(1, 1, 3, 0, 3, 3, 5), (1, 2, 3, 2, 5, 5, 3)], "plan long, id long, duration int, start int, end int, makespan int, bound int")
    _, links, demands, caps = frames(spark, [(1, 1, 1)], [(1, 1, 2, 3)], [(1, 1, "r", 2), (1, 2, "r", 2)], [(1, "r", 3)])
    assert {tuple(r) for r in levelling.levelling_faults(levelled, links, demands, caps).collect()} == {(1, "link", "1>2"), (1, "capacity", "r"), (1, "bound", "3")}
