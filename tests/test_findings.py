"""One test for each finding of a review that was right; each failed before its change."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestow.operators import balance, clauses, crating, events, ledger, levelling, passages, ranking, retrieval, schedule, stowage
from lodestow.plans import crate_queries, general_queries, intake_queries, packing_queries, text_queries
from lodestow.sources import ledger_sheets


def text_plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_snippet_trims_blanks_only(spark):
    """The line's number was taken for the characters to trim: a line of 0s and 1s lost its ends, and blanks stayed."""
    df = spark.createDataFrame([("0997 and 0\n1 the 1",), ("# head\n  a the b  ",)], "text string")
    got = df.select(passages.snippet(F.col("text"), F.array(F.lit("and"), F.lit(" the "))).alias("s")).collect()
    assert [r.s for r in got] == ["0997 and 0", "a the b"]


def test_mirrored_slabs_keep_their_distance():
    """Pieces 10 mm apart along and far apart across met when the slab of one was mirrored."""
    at, ext = [(0, 0, 0), (1010, 1900, 0)], [(1000, 500, 1000), (1000, 500, 1000)]
    for new in balance._flips(at, ext, (12032, 2400, 2698), 30):
        assert abs(new[0][1] - new[1][1]) == 1900


def test_corners_that_are_taken_are_not_tried():
    """Corners within a piece or the room beside it stayed in the list, and each later piece was compared with all of them."""
    hold = stowage._Hold((6000, 2400, 2400), 1e6, stowage.Policy())
    for k in range(40):
        hold.place({"box_id": k, "l": 500, "w": 400, "h": 600, "kg": 10.0, "stackable": True, "tips": False})
    taken = [(z, x, y) for z, x, y in map(tuple, hold.corners) for px, qx, py, qy, pz, qz in hold.near if px <= x < qx and py <= y < qy and pz <= z < qz]
    assert len(hold.at) == 40 and taken == []


def test_equal_parts_of_a_row_are_one_kind(spark):
    """Parts were made one by one only to be counted."""
    rows = spark.createDataFrame([(1, 1, 900, 500, 400, 100000, 900000.0), (1, 2, 900, 500, 400, 3, 30000.0), (1, 3, 6000, 500, 400, None, None)], "s int, r int, l int, w int, h int, qty int, total_kg double")
    kinds = crating.part_kinds(rows, "s", "r").groupBy("r").agg(F.count("*").alias("kinds"), F.sum("times").alias("parts")).collect()
    parts = {r.r: r.n for r in crating.split_rows(rows, "s", "r").groupBy("r").agg(F.count_distinct("part").alias("n")).collect()}
    assert {r.r: r.parts for r in kinds} == parts and parts[1] > 1000 and all(r.kinds <= 2 for r in kinds)


def test_support_needs_no_pairs(spark):
    """Each base met each top of its container and height: 4 million pairs here, and more than in proportion in larger tables."""
    at = F.col("id").cast("long")
    rows = spark.range(4000).select(F.lit(1).alias("c"), at.alias("box_id"), (at * 97 % 900).alias("x"), (at * 31 % 70 - 40000 * (at % 11 == 0).cast("int")).alias("y"), (at % 2 * 10).alias("z"), (at % 13 + 1).alias("dx"), (at % 7 + 1).alias("dy"), F.lit(10).alias("dz"))
    found = stowage.support_ratio(rows, "c")
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "MapInPandas" in plan
    got = {r.box_id: r.ratio for r in found.collect()}
    every = [tuple(r)[1:7] for r in rows.collect()]
    tops = [r for r in every if r[3] == 0]
    for k, x, y, z, dx, dy in every[:400]:
        area = sum(max(0, min(x + dx, u + du) - max(x, u)) * max(0, min(y + dy, v + dv) - max(y, v)) for _, u, v, _, du, dv in tops)
        assert got[k] == (1.0 if z == 0 else area / (dx * dy))
    assert len(got) == 4000


def test_a_sentence_is_cut_into_words_once(spark):
    """Each figure cut the whole sentence into words again, several times."""
    plan = text_queries.clause_masses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_best_of_groups_comes_from_tiles(spark, monkeypatch):
    """A row for each document and query was shuffled, though only the best of each path counts."""
    monkeypatch.setattr(ranking, "BLOCK", 7)
    monkeypatch.setattr(ranking, "TOGETHER", 4)
    monkeypatch.setattr(ranking, "LEAST_BLOCKS", 2)
    texts = [(k, " ".join(f"t{k * j % (11 + k % 5)}" for j in range(k % 9)) or None, f"p{k % 3}") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, path string")
    queries = spark.createDataFrame([(q, f"wt{(q * 3 + j) % 17}") for q in range(20) for j in range(5)], "query long, term string")
    every = retrieval.bm25(docs, queries).join(docs.select("doc_id", "path"), "doc_id").groupBy("query", "path").agg(F.max("score").alias("score"))
    rows = lambda df: {(r["query"], r["path"]): round(r["score"], 9) for r in df.collect()}
    got = rows(ranking.bm25_best(docs, queries, ["path"]))
    assert got == rows(every) and len(got) > 30
    found = text_plan(general_queries.kb_best_paths(spark, "/root/testdata/sf0.001"))
    assert "FlatMapCoGroupsInPandas" in found and "doc_id" not in found.split("FlatMapCoGroupsInPandas")[0]


def test_gates_read_cells_once(spark):
    """Each gate read the table anew, and its filter read a cell wherever it named it."""
    assert text_plan(intake_queries.gate_rows(spark, "/root/testdata/sf0.001")).count("row_number()") <= 2
    for query in (intake_queries.gate_invalid_quantity, intake_queries.gate_missing_weight):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter" in line and "RLIKE" in line for line in plan.splitlines())


def test_rounds_send_nothing_through_the_driver(spark):
    """What a round found was broadcast as soon as it was small, several times a round."""
    spark.catalog.clearCache()
    tasks = spark.range(40).select("id", F.lit(2).cast("bigint").alias("duration"))
    links = spark.range(1, 40).select((F.col("id") - 1).alias("before"), F.col("id").alias("after"), F.lit(0).cast("bigint").alias("lag"))
    found = schedule.critical_path(tasks, links)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 0 and plan.count("SortMergeJoin") == 1
    assert found.where("critical").count() == 40
    assert "BroadcastHashJoin" not in text_plan(schedule.link_weights(tasks, links.withColumn("kind", F.lit("FS"))))


def test_ancestors_of_many_parents(spark, monkeypatch):
    """All pairs found so far were joined and grouped again in each round: the depth a round starts from is exact now."""
    held = []
    real = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **k: held.append(real(df, *a, **k)) or held[-1])
    chain = spark.range(1, 12).select("id", (F.col("id") - 1).alias("parent"))
    got = {tuple(r) for r in schedule.ancestors(chain).collect()}
    assert got == {(i, a, i - a) for i in range(1, 12) for a in range(i)}
    assert sum(df.count() for df in held) == len(got)
    several = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (5, 2), (9, 5), (9, 1)], "id int, parent int")
    found = {(r.id, r.ancestor): r.depth for r in schedule.ancestors(several).collect()}
    assert found == {(5, 4): 1, (4, 3): 1, (3, 2): 1, (2, 1): 1, (5, 2): 1, (9, 5): 1, (9, 1): 1, (5, 3): 2, (4, 2): 2, (3, 1): 2, (5, 1): 2, (9, 4): 2, (9, 2): 2, (4, 1): 3, (9, 3): 3}
    for ring in ([(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (1, 9)]):
        with pytest.raises(ValueError, match="own ancestor"):
            schedule.ancestors(spark.createDataFrame(ring, "id int, parent int"))


def test_merged_events_are_counted(spark):
    """Unnumbered events were sorted and numbered one by one, in as few tasks as their compressed bytes filled."""
    a = spark.createDataFrame([("r", None, "x")] * 3 + [("r", 1, "x"), ("s", None, None)], "run_id string, seq long, type string")
    b = spark.createDataFrame([("r", None, "x")] * 2 + [("r", 1, "y"), ("r", 2, "y"), ("s", None, None), ("s", None, None)], "run_id string, seq long, type string")
    merged = events.merge_events(a, b)
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted([("r", None, "x")] * 3 + [("r", 1, "x"), ("r", 2, "y")] + [("s", None, None)] * 2, key=repr)
    plan = events.merge_events(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "RepartitionByExpression" in plan


def test_nearest_documents_come_from_tiles(spark, monkeypatch):
    """All scores of a task were sorted for the best of each query."""
    monkeypatch.setattr(ranking, "BLOCK", 9)
    monkeypatch.setattr(ranking, "TOGETHER", 4)
    monkeypatch.setattr(ranking, "LEAST_BLOCKS", 2)
    docs = spark.createDataFrame([(k, " ".join(f"t{k * j % (11 + k % 5)}" for j in range(k % 9)) or None) for k in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"wt{(q * 3 + j) % 17}") for q in range(20) for j in range(5)], "query long, term string")
    best = lambda df: {(r["query"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.top_k(df.withColumn("score", F.round("score", 6)), 3, "doc_id").collect()}
    assert best(ranking.bm25_nearest(docs, queries, 3)) == best(retrieval.bm25(docs, queries))


def test_levelled_plans_cost_no_frame(spark):
    """Each plan was a frame, its links and demands lists of dicts, each look at a resource an array; and the four tables were joined task by task."""
    found = text_plan(crate_queries.schedule_levelled(spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in found and "Join" not in found and "collect_list" not in found
    tasks = spark.createDataFrame([(p, k, (k * 7 + p) % 5) for p in range(3) for k in range(1, 8)] + [(None, 1, 3), (None, 1, 4)], "plan long, id long, duration int")
    links = spark.createDataFrame([(p, k, k + 1, 1) for p in range(3) for k in (1, 4, 7)] + [(None, 1, 1, 2)], "plan long, before long, after long, weight int")
    demands = spark.createDataFrame([(p, k, "r", k % 3 * 40) for p in range(3) for k in range(1, 8)] + [(2, 2, "r", 60), (None, 1, "r", 9)], "plan long, id long, resource string, units int")
    caps = spark.createDataFrame([(p, "r", 100) for p in range(3)], "plan long, resource string, capacity int")
    rows = levelling.level(tasks, links, demands, caps).cache()
    assert levelling.levelling_faults(rows, links, demands, caps).collect() == []
    got = {(r.plan, r.id, r.duration): r.start for r in rows.collect()}
    assert got[(2, 2, 1)] is None and got[(None, 1, 3)] == got[(None, 1, 4)] == 0 and sum(s is None for s in got.values()) == 1
    assert levelling.serial([3, 3, 2], [(0, 2, 1)], [{"r": 2}, {"r": 2}, {"r": 1}], {"r": 3}, [(0,), (1,), (2,)]) == [0, 3, 1]


def test_scores_of_keywords_stay_in_their_task(spark, monkeypatch):
    """All runs of all documents were shuffled, and then a row for each document and query; only the best leave a task."""
    words = ["beam", "the", "thebeams", "an", "plan", "a1", "7", "钢梁", "钢", "大钢梁柱", "x_beam"]
    docs = spark.createDataFrame([(k, " ".join(words[k * j % 11] for j in range(k % 4)) or None, " ".join(words[(k + j * j) % 11] for j in range(k % 6)), f"en/{words[k % 11]}") for k in range(70)], "doc_id long, title string, body string, path string")
    queries = spark.createDataFrame([(q, words[(q + j) % 11]) for q in range(9) for j in range(1 + q % 3)] + [(99, "nowhere")], "query int, token string")
    rows = lambda df: {(r["query"], r["doc_id"]): r["score"] for r in df.collect()}
    best = lambda df: {tuple(r) for r in retrieval.top_k(df.select("query", "doc_id", "score"), 3, "doc_id").collect()}
    scored = retrieval.keyword_score(docs, queries, "title", "body", "path")
    every, top = rows(scored), best(scored)
    assert best(retrieval.keyword_top(docs, queries, 3, "title", "body", "path")) == top and len(top) == 27
    assert text_plan(general_queries.kb_score_topk(spark, "/root/testdata/sf0.001")).count("Exchange hash") == 1
    monkeypatch.setattr(retrieval, "SENT_ROWS", 2)
    assert rows(retrieval.keyword_score(docs, queries, "title", "body", "path")) == every
    assert best(retrieval.keyword_top(docs, queries, 3, "title", "body", "path")) == top


def test_a_text_is_read_once(spark, monkeypatch):
    """Each clause was read, though many clauses have one text."""
    read = []
    real = clauses.sentences
    monkeypatch.setattr(clauses, "sentences", lambda rows, *a: read.append(rows) or real(rows, *a))
    texts = ["Max. load per container 20000 kg excluding tare.", "Any one crate shall not exceed 900 kg.", "No figure here.", "", None]
    rows = spark.range(400).select(F.col("id").alias("clause_id"), F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("id") % 5 + 1).cast("int")).alias("clause"))
    got = {r.clause_id: (r.container_kg, r.package_kg, r.basis) for r in clauses.mass_limits(rows).collect()}
    assert read[0].count() == 3
    assert got == {k: ([20000.0], [], "cargo") if k % 5 == 0 else ([], [900.0], None) for k in range(400) if k % 5 < 2}


def test_chunks_come_from_tiles(spark, monkeypatch):
    """All scores of a chunk and a query were summed and sorted in Spark; chunks that repeat a query still come last, and take no place of the others."""
    monkeypatch.setattr(ranking, "BLOCK", 9)
    monkeypatch.setattr(ranking, "TOGETHER", 4)
    monkeypatch.setattr(ranking, "LEAST_BLOCKS", 2)
    monkeypatch.setattr(retrieval, "CANDIDATES", 3)
    rows = [(k, f" Beam{'s' * (k % 2)} plan ", k % 3 == 0) for k in range(12)] + [(k, "the beam" if k % 2 else "a plan of a beam " * (k % 5), False) for k in range(12, 40)] + [(40, None, True), (41, "BEAM PLAN", True)]
    chunks = spark.createDataFrame(rows, "chunk long, text string, question boolean")
    queries = spark.createDataFrame([(1, "beam plan"), (2, "beams plan"), (3, "nothing"), (4, "the beam")], "query int, text string")
    found = retrieval.chunk_search(chunks, queries, 9, "chunk")
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.chunk)
    scored = retrieval.bm25(chunks, spark.createDataFrame([(q, f"w{w}") for q, t in ((1, "beam plan"), (2, "beams plan"), (4, "the beam")) for w in t.split()], "query int, term string"), "chunk").collect()
    again = {q: {k for k, t, asks in rows if asks and t and t.strip().lower() == text} for q, text in ((1, "beam plan"), (2, "beams plan"), (4, "the beam"))}
    for q in (1, 2, 4):
        order = sorted((r for r in scored if r["query"] == q), key=lambda r: (r.chunk in again[q], -round(r.score, 6), r.chunk))
        assert set(got[q]) == {r.chunk for r in order[:3]}
    assert set(got) == {1, 2, 4} and again[1] == {0, 6, 41}
    assert "FlatMapCoGroupsInPandas" in text_plan(found)


def test_ledger_rows_meet_once(spark):
    """Issues were made to be counted, and rows were read and joined six times."""
    plan = text_plan(intake_queries.ledger_summary(spark, "/root/testdata/sf0.001"))
    assert plan.count("Scan parquet") == 2 and "Generate" not in plan  # lines and parts
    pick = lambda k, *values: F.element_at(F.array(*(F.lit(v) for v in values)), ((F.xxhash64("id", F.lit(k)) % len(values) + len(values)) % len(values) + 1).cast("int"))
    numbers = {c: pick(c, 1, 1, 1, 2, 0, None).cast("bigint").alias(c) for c in ("quantity", "package_count", "units_per_package", "length_mm", "width_mm", "height_mm", "net_kg", "gross_kg")}
    scopes = {c: pick(c, "package", "package", "package", "row", None).alias(c) for c in ("weight_scope", "dimension_scope")}
    rows = spark.range(3000).select(
        (F.col("id") % 700).alias("shipment_id"), pick("row", 1, 2, 3, 4).cast("bigint").alias("row_id"), pick("name", "a", None).alias("name"), pick("unit", "pcs", "EA", " pc", "m2", "", None).alias("unit"),
        pick("package", "B1", " B1", "B2", "", None).alias("package_id"), pick("container", "C1", "C1 ", "C2", " ", None).alias("container_id"), *numbers.values(), *scopes.values(), F.lit(1).alias("one"),
    ).localCheckpoint()
    every = ledger.ledger_issues(rows).groupBy("shipment_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    expected = {tuple(r) for r in rows.groupBy("shipment_id").agg(F.count("*").alias("n_rows")).join(every, "shipment_id", "left").na.fill(0).collect()}
    got = ledger.issue_counts(rows, "shipment_id", "one").collect()
    assert {tuple(r)[:4] for r in got} == expected and len(got) == 700 and all(r.one == r.n_rows for r in got)
    # Packages against their definition.
    groups = {}
    raw = [r.asDict() for r in rows.collect()]
    trim = lambda x: (x or "").strip(" ")
    kinds = {}
    for r in raw:
        kinds.setdefault((r["shipment_id"], trim(r["package_id"])), set()).add(trim(r["container_id"]) == "")
    for r in raw:
        label, where = trim(r["package_id"]), trim(r["container_id"])
        mixed = bool(label) and len(kinds[r["shipment_id"], label]) == 2
        groups.setdefault((r["shipment_id"], label, "?" if mixed else where, None if label else r["row_id"]), []).append(r)
    facts = ("package_count", "length_mm", "width_mm", "height_mm", "net_kg", "gross_kg")
    stated = []
    for (shipment, _, where, _), g in groups.items():
        sound = where != "?" and all(r["weight_scope"] == r["dimension_scope"] == "package" for r in g) and all(len({r[f] for r in g}) == 1 for f in facts) and g[0]["package_count"] is not None
        stated.append((shipment, min(r["row_id"] for r in g), len(g), len(g) > 1 and not sound))
    assert sorted(stated) == sorted(tuple(r)[:4] for r in ledger.package_facts(rows, "shipment_id").collect())


def order_of_many_lines(spark, folder):
    """Two orders of one consignment, the first with 40 lines of different parts."""
    lines = spark.range(50).select((F.col("id") >= 40).cast("long").alias("l_orderkey"), (F.col("id") * 7 + 1).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.col("id").cast("int").alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    lines.select(F.col("l_partkey").alias("p_partkey"), F.lit("part").alias("p_name"), F.lit("SMALL").alias("p_type")).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_pieces_of_long_orders_have_numbers_of_their_own(spark, tmp_path):
    """The 17th line of an order had the number of the next order's first: their sizes were held against each other."""
    d = order_of_many_lines(spark, tmp_path)
    assert packing_queries._consignments(spark, d).select("consignment", "box_id").distinct().count() == 50
    assert tuple(packing_queries.stow_verify(spark, d).first()) == (50, 50, 1, 0)


def test_repaired_pieces_of_long_orders_are_their_own(spark, tmp_path):
    """Pieces that shared a number each met the weight of the other: a load had them twice."""
    assert tuple(packing_queries.balance_repair(spark, order_of_many_lines(spark, tmp_path)).first()) == (50, 0, 0)


def test_a_container_is_copied_only_when_it_takes_a_piece(monkeypatch):
    """All containers but the last were copied for each order of a lot, though the first piece of the last one most often finds no place in them."""
    copies = []
    plain = stowage._Hold.copy
    monkeypatch.setattr(stowage._Hold, "copy", lambda hold: copies.append(1) or plain(hold))
    piece = lambda k, l: {"box_id": k, "l": l, "w": 2300, "h": 2300, "kg": 10.0, "stackable": False, "tips": False}  # noqa: E741, E731
    found = stowage.stow([piece(k, 5900) for k in range(4)], (6000, 2400, 2400), 1e6, stowage.Policy())
    assert [spot[0] for spot in found] == [1, 2, 3, 4] and copies == []


def test_a_corner_knows_what_is_in_its_way():
    """Each try of a corner went through all that stands in the container, and corners with no room for any piece of the lot stayed."""
    rng = random.Random(5)
    hold = stowage._Hold((6000, 2400, 2400), 1e6, stowage.Policy(), ((400, 300, 500), (400, 300, 500)))
    for k in range(60):
        hold.place({"box_id": k, "l": rng.randrange(400, 900), "w": rng.randrange(300, 700), "h": rng.randrange(500, 800), "kg": 500.0 - k, "stackable": True, "tips": False})
    assert len(hold.at) > 20 and hold.known == set(hold.corners) and len(hold.known) == len(hold.corners)
    for z, x, y, way, under in hold.spots:
        assert sorted(way) == sorted((px, py, pz) for px, qx, py, qy, pz, qz in hold.near if x < qx and y < qy and z < qz)
        assert z == 0 or {k for k in hold.tops.get(z, ()) if x < hold.foot[k][2] and y < hold.foot[k][3]} == set(under)
        assert not any(px < x + 400 and py < y + 300 and pz < z + 500 for px, py, pz in way) and x + 400 <= 6000 and y + 300 <= 2400 and z + 500 <= 2400


def test_search_reads_the_layout_as_it_is_made(spark, tmp_path, monkeypatch):
    """The whole layout was written and read again, only to count containers."""
    monkeypatch.setattr(packing_queries.storage, "written", lambda df: pytest.fail("written"))
    assert [tuple(r) for r in packing_queries.stow_search(spark, order_of_many_lines(spark, tmp_path)).select("n_consignments", "fewer", "unfit").collect()] == [(1, 0, 0)]


def plain_crates(runs):
    """The rule part by part: into the fullest crate that takes it; then the emptiest crates go into others."""
    crates = []
    for no, r in enumerate(runs):
        for _ in range(r.times):
            takes = [c for c in crates if c.takes(r, 1)]
            host = max(takes, key=lambda c: c.net, default=None)
            if host is None:
                host = crating._Crates(r.name, r.cap)
                crates.append(host)
            host.add(no, 0, 1, r)
    crates.sort(key=lambda c: c.net)
    gone = set()
    for i, guest in enumerate(crates):
        for j in range(i + 1, len(crates)):
            host = crates[j]
            if guest.net + host.net > guest.cap + 1e-6:
                break
            room = host.room if guest.longest <= host.longest else host.held(guest.longest)
            if guest.net + host.net <= host.limit + 1e-6 and host.name in guest.fits and crating._rank(guest.longest) <= crating._rank(host.longest) and host.mm3 + guest.mm3 <= room:
                for no, _, m in guest.holds:
                    host.add(no, 0, m, runs[no])
                gone.add(i)
                crates[i + 1 :] = sorted(crates[i + 1 :], key=lambda c: c.net)
                break
    return [c for i, c in enumerate(crates) if i not in gone]


def test_equal_parts_fill_equal_crates_together():
    """Each part looked through the open crates and each crate through all others: a row of many parts cost as much for each of them."""
    names, rng, merged = [c[0] for c in crating.CRATES], random.Random(8), 0
    for _ in range(150):
        sides = lambda: (rng.choice([100, 400, 900, 1200, 1900]), rng.choice([100, 400, 1000, 1900]))
        runs = []
        for l in sorted((rng.choice([300, 900, 1600, 2600, 3600, 5600]) for _ in range(rng.randrange(1, 9))), reverse=True):  # noqa: E741
            w, h = sides()
            runs.append(crating._Run(l, w, h, rng.randrange(1, 4), rng.choice([0.0, 5.125, 80.3, 210.7, 400.0, 3000.0]), rng.choice([400.0, 480.0, 560.0, 700.0]), rng.choice(names), rng.randrange(1, 12), crating._types(w, h)))
        got, expected = crating.fill_crates(runs), plain_crates(runs)
        held = [[(no, m) for no, _, m in c.holds for _ in range(m)] for c in got for _ in range(c.count)]
        assert [sorted(no for no, _ in h) for h in held] == [sorted(no for no, _, m in c.holds for _ in range(m)) for c in expected]
        assert [c.net for c in got for _ in range(c.count)] == [c.net for c in expected]
        places = sorted((no, p) for c in got for no, start, m in c.holds for p in range(start, start + c.count * m))
        assert places == [(no, p) for no, r in enumerate(runs) for p in range(r.times)]
        merged += any(c.count > 1 for c in got)
    assert merged > 50
    assert sum(c.count for c in crating.fill_crates([crating._Run(1000, 400, 400, 1, 700.0, 700.0, "cage", 3_000_000, crating._types(400, 400))])) == 3_000_000


def test_equal_crates_are_checked_together_and_named_one_by_one(spark):
    """Every part of every crate was written to be checked."""
    rows = spark.createDataFrame([(1, 1, 500, 100, 100, 4, 8000.0)], "s long, row long, l int, w int, h int, qty int, total_kg double")
    built = spark.createDataFrame([(1, 1, [1, 2, 3, 4], 2, 1, 2000.0, 7, 2, "cage", 2000.0)], "s long, row long, parts array<int>, each int, pieces int, net_kg double, crate_no long, crates int, crate_type string, outer_l double")
    assert {tuple(r) for r in crating.crate_faults(built, rows, "s", "row").collect()} == {(1, "payload", "7"), (1, "payload", "8")}
    few = built.withColumn("crates", F.lit(1))
    assert {tuple(r) for r in crating.crate_faults(few, rows, "s", "row").collect()} == {(1, "not_conserved", "1"), (1, "payload", "7")}
    many = spark.createDataFrame([(k % 2, k, 900, 500, 400, 50, 100000.0 * k) for k in range(1, 9)], "s long, row long, l int, w int, h int, qty int, total_kg double")
    equal = crating.equal_crates(many, "s", "row")
    each = crating.build_crates(many, "s", "row")
    assert crating.crate_faults(equal, many, "s", "row").collect() == [] == crating.crate_faults(each, many, "s", "row").collect()
    assert equal.count() * 3 < each.count() == equal.agg(F.sum(F.size("parts"))).first()[0] == each.select("row", "part").distinct().count()


def test_a_heading_is_read_once_however_many_sheets_have_it(spark):
    """Each cell with letters was read as a heading, and each cell of a header twice more."""
    sheet = [(1, 0, "Case No"), (1, 1, "Net weight kg"), (2, 0, "C1"), (2, 1, "7"), (3, 0, "Subtotal"), (3, 1, "7")]
    cells = spark.createDataFrame([(doc, *cell) for doc in range(40) for cell in sheet], "doc long, row int, col int, raw string")
    headings = {r.raw: (r.fields, r.unit, r.scope) for r in ledger_sheets._headings(cells).collect()}
    assert headings == {"Case No": (["package_id"], None, None), "Net weight kg": (["net_kg"], "kg", None)}
    lines, _ = ledger_sheets._placed(cells, ["doc"])
    assert "regexp_replace" not in text_plan(lines.select("heads"))
    rows, totals = ledger_sheets.assemble(cells, "doc")
    assert rows.groupBy("package_id", "net_kg").count().collect() == [("C1", 7.0, 40)]
    assert totals.groupBy("field", "stated", "status").count().collect() == [("net_kg", 7.0, "match", 40)]


def test_a_line_is_read_as_a_row_or_as_a_total(spark, monkeypatch):
    """All lines were read for the rows and all again for the totals."""
    sheet = [(1, 0, "Case No"), (1, 1, "Net weight kg"), (2, 0, "C1"), (2, 1, "7"), (3, 0, "C2"), (3, 1, "8"), (4, 0, "Total"), (4, 1, "15")]
    cells = spark.createDataFrame([(1, *cell) for cell in sheet], "doc long, row int, col int, raw string")
    plain, read = ledger_sheets._read_lines, []
    monkeypatch.setattr(ledger_sheets, "_read_lines", lambda cells, lines, *more: read.append(sorted(r.row for r in lines.select("row").collect())) or plain(cells, lines, *more))
    _, totals = ledger_sheets.assemble(cells, "doc")
    assert read == [[2, 3], [4]] and [(r.stated, r.summed, r.n_rows, r.status) for r in totals.collect()] == [(15.0, 15.0, 2, "match")]


def test_only_what_may_be_among_the_best_paths_leaves_a_tile():
    """Of each query a row for every path and layer left each tile."""
    rng = np.random.default_rng(3)
    n, m = 300, 40
    d = pd.DataFrame({"path": rng.choice(list("abcdefgh"), n), "layer": rng.choice(["expert", "company"], n), "length": rng.integers(5, 40, n), "tids": [rng.integers(0, 30, 8) for _ in range(n)]})
    q = pd.DataFrame({"query": np.arange(m), "tids": [rng.choice(30, 4, replace=False) for _ in range(m)], "idfs": [rng.random(4) for _ in range(m)]})
    best = lambda rows: rows.assign(score=rows.score.round(4), other=rows.layer != "expert").sort_values(["query", "score", "other", "path"], ascending=[True, False, True, True]).drop_duplicates(["query", "path"]).groupby("query").head(3).reset_index(drop=True)
    every, few = ranking._best(["path", "layer"])(d, q, 20.0), ranking._best(["path", "layer"], 3)(d, q, 20.0)
    assert len(few) < 0.6 * len(every)
    pd.testing.assert_frame_equal(best(few), best(every))
    parts = pd.concat([ranking._best(["path", "layer"], 3)(d.iloc[lo : lo + 60], q, 20.0) for lo in range(0, n, 60)])
    pd.testing.assert_frame_equal(best(parts.groupby(["query", "path", "layer"], as_index=False)["score"].max()), best(every))
