import pytest
from pyspark.sql import functions as F

from lodestow.functions import numbers, text
from lodestow.operators import cargo, events, gates, ledger, packing, passages, retrieval, schedule, statistics, storage


def test_units_needed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (10.0000000001,), (10.1,)], "x double").select(cargo.units_needed(F.col("x"), F.lit(10.0)).alias("n"))
    assert [r.n for r in df.collect()] == [0, 1, 1, 1, 2]


def test_poisoned_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "k string, x long")
    assert dict(df.groupBy("k").agg(ledger.poisoned_sum(F.col("x"))).collect()) == {"a": 3, "b": None}


def test_package_counts_once_and_conflict_poisons(spark):
    df = spark.createDataFrame([("s", "p", 5), ("s", "p", 5), ("s", "q", 7), ("t", "p", 1), ("t", "p", 2), ("u", "p", None)], "g string, p string, kg long")
    rows = {r.g: r for r in ledger.package_totals(df, ["p"], ["g"], ["kg"]).collect()}
    assert (rows["s"].sum_kg, rows["s"].n_packages, rows["s"].n_conflicts) == (12, 2, 0)
    assert (rows["t"].sum_kg, rows["t"].n_conflicts) == (None, 1)
    assert (rows["u"].sum_kg, rows["u"].n_conflicts) == (None, 0)


def test_keyed_diff(spark):
    a = spark.createDataFrame([(1, 5, None), (2, 5, "x"), (3, 5, "x")], "k long, v long, w string")
    b = spark.createDataFrame([(1, 5, None), (2, 6, "y"), (4, 1, "x")], "k long, v long, w string")
    got = {r.k: (r.status, r.changed) for r in ledger.keyed_diff(a, b, ["k"], ["v", "w"]).collect()}
    assert got == {1: ("unchanged", ""), 2: ("changed", "v,w"), 3: ("withdrawn", ""), 4: ("new", "")}


def test_consolidation_skips_and_goes_on(spark):
    df = spark.createDataFrame([("s", 1, 60), ("s", 2, 50), ("s", 3, 40)], "k string, o long, l long")
    assert cargo.consolidate(df, "k", "o", "l", 100).select("placed", "used_mm").first() == (2, 100)


def test_oversize_any_way_round(spark):
    types = spark.createDataFrame([("X", 100, 50, 60)], "type string, inner_l long, inner_w long, inner_h long")
    rows = spark.createDataFrame([(1, 60, 100, 50), (2, 61, 100, 50), (3, 1, 1, 101)], "id long, length_mm long, width_mm long, height_mm long")
    assert {r.id for r in cargo.oversize(rows, types, "X").collect()} == {2, 3}


def test_merge_events(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, None, "n"), (1, None, "n")], "run_id long, seq long, v string")
    b = spark.createDataFrame([(1, 1, "b"), (1, 2, "b"), (1, None, "n"), (1, None, "m")], "run_id long, seq long, v string")
    got = sorted((r.seq or 0, r.v) for r in events.merge_events(a, b).collect())
    assert got == [(0, "m"), (0, "n"), (0, "n"), (1, "a"), (2, "b")]


def test_prune_keeps_young_and_counts(spark):
    rows = [(f"r{k}", "s", f"2024-01-0{k}") for k in range(1, 6)] + [("x", None, "2024-01-01"), ("y", None, "2024-02-01")]
    df = spark.createDataFrame(rows, "run_id string, session_id string, started_at string")
    got = {r.run_id for r in events.prune(df, F.lit("2024-01-31"), 3).where("archived").collect()}
    assert got == {"r1", "r2", "r3", "x"}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "a", 5)], "k long, v string, ver long")
    new = spark.createDataFrame([(1, "b", 1), (2, "b", 4), (3, "b", 1)], "k long, v string, ver long")
    assert {(r.k, r.v) for r in events.upsert_latest(base, new, ["k"], "ver").collect()} == {(1, "b"), (2, "a"), (3, "b")}


def test_quantity_cells(spark):
    cells = ["0", "2.7", "abc", "-3", "NaN", "3 EA", "", None, "12"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(numbers.quantity(F.col("c")).alias("q"))
    assert [(r.q.state, r.q.qty) for r in df.collect()] == [("zero", None), ("invalid", None), ("invalid", None), ("invalid", None), ("invalid", None), ("ok", 3), ("missing", None), ("missing", None), ("ok", 12)]


def test_dimensions_and_weights(spark):
    df = spark.createDataFrame([("1,200 x 800 × 600",), ("x",)], "c string").select(numbers.dimensions(F.col("c")).alias("d"))
    assert [tuple(r.d) for r in df.collect()] == [(1200.0, 800.0, 600.0), (None, None, None)]
    df = spark.createDataFrame([("2 t",), ("500g",), ("10 lb",), ("3-5 kg",), ("12",)], "c string").select(F.round(numbers.weight_kg(F.col("c")), 4).alias("w"))
    assert [r.w for r in df.collect()] == [2000.0, 0.5, 4.5359, None, 12.0]


def test_upper_median(spark):
    df = spark.createDataFrame([([4, 1, 3, 2],), ([5],)], "x array<long>").select(numbers.upper_median(F.col("x")).alias("m"))
    assert [r.m for r in df.collect()] == [3, 5]


def test_tokens(spark):
    df = spark.createDataFrame([("Ab 装箱单 a 7 ab",)], "t string")
    assert df.select(text.tokens(F.col("t")).alias("x")).first().x == ["ab", "装箱单", "装箱", "箱单", "7"]
    assert df.select(text.index_tokens(F.col("t")).alias("x")).first().x == ["wab", "u装", "u箱", "u单", "b装箱", "b箱单", "wa", "w7", "wab"]


def test_citations(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    sha = docs.select(F.sha2("text", 256)).first()[0]
    cites = spark.createDataFrame([(1, 1, sha, "bc"), (2, 1, sha, "x"), (3, 1, "0", "bc"), (4, 9, sha, "bc")], "cite_id long, doc_id long, sha string, quote string")
    assert {r.cite_id: r.reason for r in retrieval.verify_citations(cites, docs).collect()} == {1: "ok", 2: "misquoted", 3: "changed", 4: "missing"}


def test_critical_path_and_cycle(spark):
    tasks = spark.createDataFrame([(1, 3), (2, 2), (3, 4), (4, 1)], "id long, duration long")
    links = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (2, 4, 0), (3, 4, 1)], "before long, after long, lag long")
    got = {r.id: (r.es, r.ls, r.critical) for r in schedule.critical_path(tasks, links).collect()}
    assert got == {1: (0, 0, True), 2: (3, 6, False), 3: (3, 3, True), 4: (8, 8, True)}
    with pytest.raises(ValueError):
        schedule.earliest_starts(tasks, links.unionByName(spark.createDataFrame([(4, 1, 0)], "before long, after long, lag long")))


def test_routes(spark):
    edges = spark.createDataFrame([(0, 1, 5), (0, 2, 1), (2, 1, 1), (3, 0, 1), (0, 1, 9)], "from long, to long, weight long")
    assert {r.node: r.distance for r in schedule.shortest_routes(edges, 0).collect()} == {0: 0, 1: 2, 2: 1, 3: None}


def test_conservation_in_any_split(spark):
    """Seven pieces whole in 13, 19, 23 or 29 parts are kept, exactly; a part less is not."""
    materials = spark.createDataFrame([(k, 7) for k in (13, 19, 23, 29, 0)], "row_id long, quantity long")
    contents = spark.createDataFrame([(13, 91, 13), (19, 133, 19), (23, 161, 23), (29, 202, 29), (0, 3, 1), (0, 22, 11), (0, 6, 3)], "row_id long, quantity long, split_of long")
    got = {r.row_id: (r.pieces_in, r.pieces_out, r.kind) for r in ledger.conservation(materials, contents, ["row_id"]).collect()}
    assert got == {29: (7, round(202 / 29, 6), "pieces_lost")}


def test_heavy_rests_on_what_touches_it(spark):
    rows = [("s", 1, 0, 0, 0, 10, 10, 9, 100), ("s", 2, 0, 0, 9, 10, 10, 5, 200), ("s", 3, 0, 0, 14, 5, 5, 5, 240), ("s", 4, 0, 20, 9, 9, 9, 9, 999), ("s", 5, 0, 20, 0, 9, 9, 8, 1)]
    layout = spark.createDataFrame(rows, "k string, box_id long, x long, y long, z long, dx long, dy long, dz long, kg long")
    assert cargo.heavy_on_top(layout, "k").first().asDict() == {"k": "s", "total_kg": 1540, "heavy_kg": 200, "ratio": round(200 / 1540, 6)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", None), ("c", 5.0)], "k string, v double")
    got = {r.k: (r.n, r.upper_median) for r in statistics.upper_median(df, ["k"], F.col("v")).collect()}
    assert got == {"a": (4, 3.0), "c": (1, 5.0)}


def test_hollow_section_is_safe_either_way(spark):
    df = spark.createDataFrame([(40.0, 100.0, 4.0), (100.0, 40.0, 4.0), (40.0, 100.0, 20.0)], "b double, h double, t double")
    high, wide, none = (r.s for r in df.select(numbers.hollow_section(F.col("b"), F.col("h"), F.col("t")).alias("s")).collect())
    assert high.radius == wide.radius and high.modulus == pytest.approx(wide.modulus) and none.area is None


def test_keyword_score_finds_parts_of_words(spark):
    docs = spark.createDataFrame([(1, "Formwork plan", "the beams", "en/x"), (2, "plan", "nothing", "beam/y"), (3, "other", "else", "z")], "doc_id long, title string, body string, path string")
    queries = spark.createDataFrame([("q", "beam"), ("q", "plan")], "query string, token string")
    got = {r.doc_id: r.score for r in retrieval.keyword_score(docs, queries, "title", "body", "path").collect()}
    assert got == {1: pytest.approx(0.8 + 1 + 2.5 + 0.8), 2: pytest.approx(1.2 + 1 + 2.5 + 0.8)}


def test_chunks_end_at_lines(spark):
    text_ = "x" * 700 + "\n" + "y" * 900 + "\n" + "z" * 1300
    got = [(r.start, r.end) for r in packing.chunks(spark.createDataFrame([(1, text_), (2, ""), (3, None)], "doc_id long, text string")).collect()]
    assert got == [(0, 701), (541, 1602), (1442, 2642), (2482, 2902)]
    assert packing.chunks(spark.createDataFrame([(1, "a" * 1201)], "doc_id long, text string")).count() == 2


def test_schedules_of_any_depth_and_kind(spark):
    n = 260
    tasks = spark.createDataFrame([(k, 1) for k in range(4)], "id long, duration long")
    links = spark.createDataFrame([(0, 1, "FS", 2), (1, 2, "FF", 3), (0, 3, "SS", 1)], "before long, after long, kind string, lag long")
    got = {r.id: (r.es, r.ls, r.critical) for r in schedule.schedule(tasks, links).collect()}
    assert got == {0: (0, 0, True), 1: (3, 3, True), 2: (6, 6, True), 3: (1, 6, False)}
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, n)], "id long, parent long")
    assert schedule.ancestors(chain).agg(F.max("depth")).first()[0] == n - 1
    with pytest.raises(ValueError, match="ancestor"):
        schedule.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))


def test_turns_and_keys(spark):
    requests = spark.createDataFrame([("w", "s", "k1", "a"), ("w", "s", "k2", "a"), ("w", "t", "k3", "a"), ("w", "u", "k4", "a")], "workspace_id string, session_id string, key string, sha string")
    keys = spark.createDataFrame([("w", "k1", "s", "a", "t1"), ("w", "k2", "s", "b", "t2")], "workspace_id string, key string, session_id string, sha string, turn_id string")
    turns = spark.createDataFrame([("w", "s", "running"), ("w", "t", "running"), ("w", "u", "done")], "workspace_id string, session_id string, status string")
    got = {r.key: (r.outcome, r.turn_id) for r in storage.start_turns(requests, keys, turns).collect()}
    assert got == {"k1": ("existing", "t1"), "k2": ("conflict", None), "k3": ("busy", None), "k4": ("started", None)}


def test_numbers_are_decimal_and_nothing_else(spark):
    cells = ["12", " 3.5 ", "-1e3", ".5", "5.", "5d", "12f", "0x1f", "inf", "NaN", "1 2", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in cells], "c string").select(numbers.plain_double(F.col("c"))).collect()]
    assert got == [12, 3.5, -1000, 0.5, 5, *[None] * 8]


def test_packaging_is_told_from_cargo(spark):
    equipment = ["Glass stillage", "stillage unit", "玻璃周转架", "A-frame for panels", "Returnable rack for glazing units", "a frame to carry big heavy glass", "steel racks holding units"]
    cargo = ["Unitised panel on A-frame stillage", "Vision panel, on A-frame", "curtain wall panel", "rack", "steel frame", "A-frame, glass", None]
    rows = spark.createDataFrame([(x, "") for x in equipment + cargo] + [("Vision panel", "A-frame"), ("A-frame", "stillage")], "name string, spec string")
    assert sorted(r.name for r in gates.packaging(rows, "name", "spec").collect()) == sorted([*equipment, "A-frame"])


def test_masses_are_read_once_and_never_from_money(spark):
    cases = {
        "20 t (44,092 lbs) gross": [20000], "20 metric tons": [20000], "1 250 kg": [1250], "pay up to 5,000 pounds per container per day": [], "gross weight 12 mt, 12 mt long": [12000], "12 mt": [],
        "44,000 lbs (19,958 kg)": [19958.1], "no crate over 2 t or 800kgs": [2000, 800], "mass 5,000 pounds": [2268], "1.2.3 kg": [], "各柜限重20吨": [20000], "20 t, 20 t": [20000, 20000], "": [],
    }
    df = spark.createDataFrame([(x,) for x in [*cases, None]], "c string").select("c", passages.masses_kg(F.col("c")).alias("m"))
    assert {r.c: r.m for r in df.collect()} == {**cases, None: None}


def test_container_codes_in_any_spelling(spark):
    cases = {"High-cube 40'": ["HQ"], "40’HQ": ["40HQ"], "use OT or fr": ["OT"], "40 ft high cube and 20' GP": ["20GP", "40HQ"], "开顶柜": ["OT"], "40 框架集装箱": ["FR"], "a40HQ 40HQs": [], "20ft open top, 40 flat-rack": ["20OT", "40FR"]}
    df = spark.createDataFrame([(x,) for x in cases], "c string").select("c", passages.container_codes(F.col("c")).alias("m"))
    assert {r.c: r.m for r in df.collect()} == cases


def test_chunks_follow_from_the_text_alone(spark):
    texts = ["a" * 5000, "x\n" * 3000, ("句" * 700 + "。") * 9, "short", "", None, "b" * 1200, "b" * 1201]
    got = {}
    for r in packing.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.quote))
    assert sorted(got) == [0, 1, 2, 3, 6, 7]
    for k, parts in got.items():
        text = texts[k]
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
        assert all(q == text[a:b] and b - a <= 1200 for a, b, q in parts)
        assert all(b - 160 == c for (_, b, _), (c, _, _) in zip(parts, parts[1:], strict=False))
        assert all(b - a == 1200 and not set("\n。") & set(text[a + 600 : b]) or text[b - 1] in "\n。" for a, b, _ in parts[:-1])


def test_chunk_search_weighs_coverage_phrase_and_repeats(spark):
    rows = [
        ("a", True, "Where is the blue crane?"), ("b", False, "the blue crane is where it was, where is the blue crane? here"), ("c", False, "blue"), ("d", False, "nothing of it"), ("e", True, "where IS the blue crane? it is late"),
        ("f", False, "\u585d\u540a"), ("g", False, "\u540a"),
    ]
    chunks = spark.createDataFrame(rows, "chunk string, question boolean, text string")
    queries = spark.createDataFrame([(1, " where is the blue crane? "), (2, "\u585d\u540a"), (3, "\u540a"), (4, "")], "query long, text string")
    found = retrieval.chunk_search(chunks, queries, 9, "chunk").collect()
    got = {q: [r.chunk for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q] for q in (1, 2, 3, 4)}
    assert set(got[1][:2]) == {"b", "e"} and got[1][2:] == ["c", "a"]
    assert got[2] == ["f"] and set(got[3]) == {"f", "g"}
    assert got[4] == []
    score = {r.chunk: r.score for r in found if r["query"] == 1}
    assert score["a"] < -900 and 9 <= score["e"] <= 14 and 1 <= score["c"] <= 6
