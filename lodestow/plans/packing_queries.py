"""Booking, packing, structure and index queries over the driver's tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import balance, packing, storage, stowage, structure
from ..operators.statistics import upper_median
from .tables import SQL_CARGO, cargo, table


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A crate for each line: 60 mm of wall on every side."""
    rows = cargo(spark, d)
    return rows.select("shipment_id", F.col("row_id").alias("box_id"), (F.col("length_mm") + 120).alias("l"), (F.col("width_mm") + 120).alias("w"), (F.col("height_mm") + 120).alias("h"), (F.col("weight_kg") + 90).alias("kg"), (F.col("length_mm") * F.col("width_mm") * F.col("height_mm")).alias("content_mm3"))


_BOXES = f"WITH {SQL_CARGO}, boxes AS (SELECT shipment_id, row_id AS box_id, length_mm + 120 AS l, width_mm + 120 AS w, height_mm + 120 AS h, weight_kg + 90 AS kg, length_mm * width_mm * height_mm AS c FROM cargo)"


def cargo_booking_volume(spark: SparkSession, d: str) -> DataFrame:
    return packing.booking_volume(_boxes(spark, d).withColumn("outer_mm3", F.col("l") * F.col("w") * F.col("h")), "shipment_id")


def cargo_geom_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    return packing.geometric_bounds(_boxes(spark, d), 12032, 2352, 0.88, "shipment_id")


def nonstandard_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of each row and the most serious level, counted."""
    b = _boxes(spark, d)
    flags = F.array_compact(F.array(F.when(F.col("l") > 5900, "overlong"), F.when(F.col("kg") > 2000, "heavy"), F.when(F.col("h") > 1200, "tall"), F.when(F.col("l") > 12 * F.least("w", "h"), "slender")))
    level = F.when(F.array_contains("flags", "overlong"), "NEED_DESIGN").when(F.size("flags") >= 2, "WARN").when(F.size("flags") == 1, "INFO").otherwise("PASS")
    marked = b.withColumn("flags", flags).withColumn("level", level)
    return marked.groupBy("level", F.concat_ws(",", "flags").alias("flags")).agg(F.count("*").alias("n"))


def secure_work_order(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, beams and straps of crates of four times their weight, a container for every third row."""
    b = _boxes(spark, d)
    place = {"x": (F.col("l") * 97 + F.col("box_id") * 1571) % 11000, "y": F.col("w") * 31 % 1800, "z": F.col("box_id") % 2 * 900}
    layout = b.withColumns(place).select("shipment_id", (F.col("box_id") % 3).alias("container_no"), "box_id", "x", "y", "z", F.col("l").alias("dx"), F.col("w").alias("dy"), F.col("h").alias("dz"), (F.col("kg") * 4).alias("kg"))
    return packing.secure_work_order(layout, 28610.0, "shipment_id", "container_no")


def material_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First row of each (name without blanks, total weight to 0.1, container); how many rows of each name stay."""
    rows = cargo(spark, d).withColumn("k", F.substring(F.regexp_replace("name", "\\s+", ""), 1, 40)).withColumn("total", F.col("weight_kg") * F.col("qty"))
    first = F.row_number().over(Window.partitionBy("k", "total", F.col("shipment_id") % 10).orderBy("shipment_id", "row_id"))
    return rows.withColumn("n", first).where("n = 1").groupBy("k").agg(F.count("*").alias("kept"), F.sum("total").alias("total_kg"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    found = packing.chunks(table(spark, d, "documents"))
    return found.select("doc_id", "chunk", "start", "end", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string"), "quote"), 256).alias("chunk_id"))


def pack_3d_layout(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_layers(_boxes(spark, d), 12032, 2352, 2698, 28610.0, "shipment_id")


def pack_verify(spark: SparkSession, d: str) -> DataFrame:
    """Shipments, containers and violations of the layout; no violation is right."""
    boxes = _boxes(spark, d)
    layout = packing.pack_layers(boxes, 12032, 2352, 2698, 28610.0, "shipment_id")
    bad = packing.verify_layout(layout, boxes.select("shipment_id", "box_id", "kg"), 12032, 2352, 2698, 28610.0, "shipment_id").agg(F.count("*").alias("violations"))
    return layout.agg(F.count("*").alias("n_boxes"), F.count_distinct("shipment_id").alias("n_shipments")).crossJoin(bad)  # one row each


SIZE, PAYLOAD = (12032, 2352, 2698), 28610.0


def _consignments(spark: SparkSession, d: str) -> DataFrame:
    """Crates of eight orders at a time; one in five orders bears nothing on top, one in three may be laid on its side."""
    order = F.col("shipment_id")
    # However many lines an order has, no two pieces share a number.
    return _boxes(spark, d).select(F.floor(order / 8).alias("consignment"), (order * 2**32 + F.col("box_id")).alias("box_id"), "l", "w", "h", "kg", (order % 5 != 0).alias("stackable"), (order % 3 == 0).alias("tips"))


def _stowed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The layout, written once, and its pieces."""
    pieces = _consignments(spark, d)
    return storage.written(stowage.stow_shipments(pieces, SIZE, PAYLOAD, "consignment")), pieces


def stow_layout(spark: SparkSession, d: str) -> DataFrame:
    return stowage.stow_shipments(_consignments(spark, d), SIZE, PAYLOAD, "consignment")


def stow_verify(spark: SparkSession, d: str) -> DataFrame:
    """Pieces, pieces placed, and faults of the layout: none is right."""
    layout, pieces = _stowed(spark, d)
    faults = stowage.stowage_faults(layout, pieces, SIZE, PAYLOAD, "consignment").agg(F.count("*").alias("faults"))
    return layout.agg(F.count("*").alias("n_pieces"), F.count_if(F.col("container_no") > 0).alias("n_placed"), F.count_distinct("consignment").alias("n_consignments")).crossJoin(faults)  # one row each


def stow_search(spark: SparkSession, d: str) -> DataFrame:
    """By the fewest containers that weight and volume allow: consignments, and how many took fewer (none can) or left a piece out."""
    pieces = _consignments(spark, d)
    found = balance.container_search(stow_layout(spark, d), pieces, SIZE, PAYLOAD, 0.95, 99, "consignment")
    return found.groupBy("n0").agg(F.count("*").alias("n_consignments"), F.count_if(F.col("n") < F.col("n0")).alias("fewer"), F.count_if(~F.col("fits")).alias("unfit"))


def balance_repair(spark: SparkSession, d: str) -> DataFrame:
    """Containers moved as a whole and then repaired: pieces, faults, and containers in worse balance than before; the last two are 0."""
    layout, pieces = _stowed(spark, d)
    loads = layout.where("container_no > 0").join(pieces.select("consignment", "box_id", "kg", "stackable", "tips"), ["consignment", "box_id"])
    keys = ("consignment", "container_no")
    moved = balance.rigid(loads, SIZE, *keys).drop("move")
    better = storage.written(balance.repair(moved, SIZE, PAYLOAD, *keys))
    first = balance.balance(loads, SIZE, *keys).select(*keys, F.col("score").alias("first"))
    last = balance.balance(better, SIZE, *keys).join(first, list(keys)).agg(F.count_if(F.col("score") > F.col("first") + 1e-6).alias("worse"))
    faults = stowage.stowage_faults(better, pieces, SIZE, PAYLOAD, "consignment").agg(F.count("*").alias("faults"))
    return better.agg(F.count("*").alias("n_pieces")).crossJoin(faults).crossJoin(last)  # one row each


def _stood(spark: SparkSession, d: str) -> DataFrame:
    """Crates put down by rule, in two layers of one height, a container for every third row."""
    b = _boxes(spark, d)
    place = {"x": (F.col("l") * 97 + F.col("box_id") * 1571) % 5000, "y": F.col("w") * 31 % 1200, "z": F.col("box_id") % 2 * 900}
    return b.withColumns(place).select("shipment_id", (F.col("box_id") % 2).alias("container_no"), (F.col("shipment_id") * 16 + F.col("box_id")).alias("box_id"), "x", "y", "z", F.col("l").alias("dx"), F.col("w").alias("dy"), F.lit(900).alias("dz"), "kg")


def stow_support(spark: SparkSession, d: str) -> DataFrame:
    """The share of each base that stands on something, where orders of a customer's tenth share a container."""
    rows = _stood(spark, d).withColumn("container_no", F.col("shipment_id") % 500)
    return stowage.support_ratio(rows, "container_no").select("container_no", "box_id", F.round("ratio", 6).alias("ratio"))


def balance_rigid(spark: SparkSession, d: str) -> DataFrame:
    """The rigid move of each container and its score after it."""
    moved = balance.rigid(_stood(spark, d), SIZE, "shipment_id", "container_no")
    return balance.balance(moved, SIZE, "shipment_id", "container_no", "move").select("shipment_id", "container_no", "move", F.round("score", 6).alias("score"))


def bending_check(spark: SparkSession, d: str) -> DataFrame:
    """Bending of two bottom beams under each crate: the worse of the long span and the support span decides."""
    b = _boxes(spark, d)
    span = F.least(F.lit(1500.0), F.greatest(F.lit(600.0), F.col("l") / 3))
    moment = F.greatest(F.col("kg") * 9.8 / 2 * F.col("l") / 8, F.col("kg") * 9.8 / 2 * span / 8)
    sigma = moment / 25300.0
    return b.select("shipment_id", "box_id", F.round(sigma, 3).alias("sigma_mpa"), (sigma <= 205.0).alias("ok"))


def index_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Added, updated, unchanged and removed documents between two inventories (path, size)."""
    now = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"))
    old = now.where("doc_id % 10 <> 3").select("doc_id", (F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("old")).unionByName(now.where("doc_id % 5 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.col("size").alias("old")))
    both = now.join(old, "doc_id", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("size").isNull(), "removed").when(F.col("old") != F.col("size"), "updated").otherwise("unchanged")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each clerk's list of statements: covered counts 1, partial 0.5, gaps -0.75, reviews -0.35, clamped to 0 to 1. Kept in hundredths."""
    o = table(spark, d, "orders")
    points = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 50).when(F.col("o_orderkey") % 3 == 0, -75).otherwise(-35)
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(points) / F.count("*") / 100)), 4).alias("score"))


def eval_table(spark: SparkSession, d: str) -> DataFrame:
    """Runs, upper median, maximum and failures of each kind of event."""
    e = table(spark, d, "events")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.count_if(F.col("value") > 50).alias("over_50"))
    return counts.join(upper_median(e, ["event_type"], F.col("value")).drop("n"), "event_type", "left")


def plan_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ between two versions of each supplier's figures: both unpivoted, joined by field."""
    base = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("bigint").alias("pieces"), F.max("l_linenumber").cast("bigint").alias("last_line"))
    long = base.unpivot(["l_suppkey", "l_linestatus"], ["n_lines", "pieces", "last_line"], "field", "value")
    a, b = (long.where(F.col("l_linestatus") == s).select("l_suppkey", "field", F.col("value").alias(s)) for s in ("F", "O"))
    return a.join(b, ["l_suppkey", "field"]).where(~F.col("F").eqNullSafe(F.col("O"))).select("l_suppkey", "field", F.col("F").alias("before"), F.col("O").alias("after"))


def monthly_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The three customers with most orders of each month; equal counts by key."""
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("month").orderBy(F.desc("n"), "o_custkey")
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def util_band(spark: SparkSession, d: str) -> DataFrame:
    """Points of a utilisation between 0 and 1: 100 from good on, 60 to 100 from the soft minimum on, below in proportion."""
    v = F.col("p_size") / 50
    score = F.when(v >= 0.8, 100.0).when(v >= 0.5, 60 + 40 * (v - 0.5) / 0.3).otherwise(60 * v / 0.5)
    return table(spark, d, "part").select("p_partkey", F.round(score, 4).alias("score"))


def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sections by name: tubes in several spellings, timber, and names that are neither."""
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    name = F.when(k == 0, F.concat(F.lit("方管"), size, F.lit("x"), size, F.lit("x3"))).when(k == 1, F.concat(F.lit("RHS "), size + 20, F.lit("×"), size, F.lit("×2.5")))
    name = name.when(k == 2, F.concat(F.lit("木梁"), size + 50, F.lit("x"), size + 80)).when(k == 3, F.concat(size, F.lit("*"), size + 9, F.lit("*4"))).when(k == 4, F.lit("H beam"))
    part = table(spark, d, "part").select("p_partkey", numbers.section(name).alias("s")).where("s.kind IS NOT NULL")
    b, h, t = F.col("s.b"), F.col("s.h"), F.col("s.t")
    area = F.when(F.col("s.kind") == "wood_rect", numbers.solid_section(b, h)["area"]).otherwise(numbers.hollow_section(b, h, t)["area"])
    inertia = F.when(F.col("s.kind") == "wood_rect", numbers.solid_section(b, h)["inertia"]).otherwise(numbers.hollow_section(b, h, t)["inertia"])
    return part.select("p_partkey", "s.kind", "s.b", "s.h", F.round(area, 3).alias("area"), F.round(inertia, 3).alias("inertia"))


def crate_stability(spark: SparkSession, d: str) -> DataFrame:
    """Four columns under each crate, steel for even rows and timber for odd ones."""
    b = _boxes(spark, d)
    steel = F.col("box_id") % 2 == 0
    found = structure.column_stability(F.col("kg") * 1.8, F.col("h").cast("double"), F.lit(4.2), F.col("w") % 7 / 10 + 0.5, steel)
    return b.select("shipment_id", "box_id", found.alias("c")).select("shipment_id", "box_id", F.round("c.axial_n", 9).alias("axial_n"), F.round("c.slenderness", 9).alias("slenderness"), F.round("c.stress", 9).alias("stress"), "c.band", "c.status")


def crate_supports(spark: SparkSession, d: str) -> DataFrame:
    """Bearing and lifting of each crate: some know their heaviest piece, some their pad, some are hung off centre."""
    b, k = _boxes(spark, d), F.col("box_id") % 3
    bearing = structure.local_bearing(F.col("kg") * 8.0, F.when(k == 0, F.col("kg") * 5.0).otherwise(0.0), F.when(k == 1, 900.0).otherwise(0.0), k == 2)
    lifting = structure.lifting_points(F.col("kg").cast("double"), k * 2, F.col("l") % 2 == 0, F.when(F.col("w") % 5 == 0, 1.4).otherwise(1.0))
    each = b.select("shipment_id", "box_id", bearing.alias("b"), lifting.alias("l"))
    return each.select("shipment_id", "box_id", F.col("b.stress").alias("bearing_mpa"), F.col("b.status").alias("bearing"), F.col("l.force_n").alias("force_n"), F.col("l.status").alias("lifting"))


# --- keyed tables


def _run_table(spark: SparkSession, d: str) -> DataFrame:
    """A run for each order, its state by whole-number rules."""
    k = F.col("o_orderkey")
    state = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.floor(k / 3) % len(names) + 1).cast("int"))
    columns = {"run_id": k, "session_id": F.when(k % 7 != 0, F.col("o_custkey")), "phase": state("packing", "done", "", "check"), "status": state("running", "ok", None, "resumed", "")}
    ended = F.when(k % 5 == 0, F.to_date("o_orderdate").cast("string"))
    return table(spark, d, "orders").select(*(c.alias(n) for n, c in columns.items()), ended.alias("ended_at"), (k % 11 == 0).alias("archived"))


def runs_interrupt_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a settling event: those with a line returned."""
    events = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "done").otherwise("tick").alias("type"))
    out = storage.interrupt_orphans(_run_table(spark, d), events, ["packing", "check"], ["done", "hitl"], F.lit("now"))
    return out.groupBy("phase", F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("ended_at", F.lit("-")).alias("ended_at")).agg(F.count("*").alias("n"))


def runs_placeholders(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("session_id"), F.lit("saved").alias("status"))
    return storage.with_placeholders(sessions, _run_table(spark, d))


def runs_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = o.where("o_orderkey % 3 = 0")
    more = o.withColumn("o_orderstatus", F.lit("N")).unionByName(o.withColumn("o_orderstatus", F.lit("M")).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return storage.insert_or_ignore(base, more, ["o_orderkey"], "o_totalprice").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def documents_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by source after one in five documents has new ones and one in eleven is deleted."""
    parts = packing.chunks(table(spark, d, "documents")).select("doc_id", "chunk", F.char_length("quote").cast("bigint").alias("size"))
    changed = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(0).cast("bigint").alias("chunk"), F.lit(7).cast("bigint").alias("size"))
    gone = table(spark, d, "documents").where("doc_id % 11 = 0").select("doc_id")
    left = storage.delete_documents(storage.replace_documents(parts, changed, ["doc_id"]), gone, ["doc_id"])
    return left.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of events after an hour-long put: expired ones gone, of a key the latest put."""
    e = table(spark, d, "events").select(F.col("event_type").alias("scope"), (F.col("user_id") % 997).alias("key"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"))
    bound = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    out = storage.remember(e.where("event_id % 2 = 0").groupBy("scope", "key").agg(F.max("event_id").alias("event_id"), F.max("created_at").alias("created_at")), e.where("event_id % 10 = 1").groupBy("scope", "key").agg(F.min("event_id").alias("event_id"), F.min("created_at").alias("created_at")), bound)
    return out.groupBy("scope").agg(F.count("*").alias("n"), F.sum("event_id").alias("events"))


def turns_start(spark: SparkSession, d: str) -> DataFrame:
    """Requests for turns: retries, reused keys, busy sessions and new ones."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("workspace_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("sha"))
    keys = o.where("key % 4 = 0").select("workspace_id", "key", F.when(F.col("key") % 8 == 0, F.col("session_id")).otherwise(F.col("session_id") + 5).alias("session_id"), F.when(F.col("key") % 16 == 0, F.lit("x")).otherwise(F.col("sha")).alias("sha"), (F.col("key") * 10).alias("turn_id"))
    turns = table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("workspace_id"), F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 9 == 0, "running").otherwise("done").alias("status"))
    found = storage.start_turns(o, keys, turns)
    return found.groupBy("workspace_id", "outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum("turn_id"), F.lit(0)).alias("turns"))


QUERIES = {
    f.__name__: f
    for f in (
        cargo_booking_volume, cargo_geom_lower_bound, nonstandard_flags, secure_work_order, material_dedupe, chunk_windows, pack_3d_layout, pack_verify, stow_layout, stow_verify, stow_search, stow_support, balance_rigid, balance_repair, bending_check, index_staleness, readiness_score, eval_table, plan_diff, monthly_ranking, util_band,
        section_lookup, crate_stability, crate_supports, runs_interrupt_orphans, runs_placeholders, runs_insert_or_ignore, documents_replace, idempotency_keys, turns_start,
    )
}

_CHUNKS = r"""WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS chunk, 0::BIGINT AS start, CASE WHEN length(text) <= 1200 THEN length(text) ELSE coalesce(nullif(length(regexp_extract(substr(text, 1, 1200), '(?s)^.{600,}[\n。]')), 0), 1200) END AS stop FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, text, chunk + 1, stop - 160, CASE WHEN stop - 160 + 1200 >= length(text) THEN length(text) ELSE stop - 160 + coalesce(nullif(length(regexp_extract(substr(text, stop - 160 + 1, 1200), '(?s)^.{600,}[\n。]')), 0), 1200) END FROM w WHERE stop < length(text))"""
_RUN_TABLE = """r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS session_id, (['packing', 'done', '', 'check'])[o_orderkey // 3 % 4 + 1] AS phase, (['running', 'ok', NULL, 'resumed', ''])[o_orderkey // 3 % 5 + 1] AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS ended_at, o_orderkey % 11 = 0 AS archived FROM orders)"""
_STOOD = f"""{_BOXES}, stood AS (SELECT shipment_id, box_id % 2 AS container_no, shipment_id * 16 + box_id AS box_id, (l * 97 + box_id * 1571) % 5000 AS x, w * 31 % 1200 AS y, box_id % 2 * 900 AS z, l AS dx, w AS dy, 900 AS dz, kg FROM boxes)"""
_LENGTH, _WIDTH, _HIGH = SIZE
_SCORE = "greatest(0.6::DOUBLE - mid, 0) * 20 + CASE WHEN mid < 0.4 THEN 15 WHEN mid < 0.5 THEN 5 ELSE 0 END + abs(along - 0.5) * 4 + greatest(across - 0.05::DOUBLE, 0) * 8 + greatest(height - 0.55::DOUBLE, 0) * 3"
#: Every move of every container with its score; the best is the lowest, the earlier of equals.
_RIGID_SQL = f"""{_STOOD}, s AS (SELECT shipment_id, container_no, sum(kg) AS m, sum((2 * x + dx) * kg) AS mx, sum((2 * y + dy) * kg) AS my, min(x) AS lox, max(x + dx) AS hix, min(y) AS loy, max(y + dy) AS hiy FROM stood GROUP BY 1, 2),
  w AS (SELECT *, greatest(-lox, least({_LENGTH} - hix, floor(({_LENGTH} * m - mx) / (2 * m)))) AS sx, greatest(-loy, least({_WIDTH} - hiy, floor(({_WIDTH} * m - my) / (2 * m)))) AS sy FROM s),
  q AS (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest(['stay', 'shift', 'turn', 'mirror', 'shift_mirror']) AS move),
  p AS (SELECT t.shipment_id, t.container_no, i, move, kg, z, dx, dy, dz, CASE WHEN i IN (1, 4) THEN x + sx WHEN i = 2 THEN {_LENGTH} - x - dx ELSE x END AS x, CASE WHEN i IN (1, 4) THEN y + sy ELSE y END AS y0 FROM stood t JOIN w USING (shipment_id, container_no), q),
  r AS (SELECT *, CASE WHEN i IN (3, 4) THEN {_WIDTH} - y0 - dy ELSE y0 END AS y FROM p),
  b AS (SELECT shipment_id, container_no, i, move, sum(CASE WHEN 2 * (2 * x + dx) BETWEEN {_LENGTH} AND {3 * _LENGTH} THEN kg ELSE 0 END) / sum(kg) AS mid, sum((2 * x + dx) * kg) / sum(kg) / {2 * _LENGTH} AS along, abs(sum((2 * y + dy) * kg) / sum(kg) / {_WIDTH} - 1) AS across, sum((2 * z + dz) * kg) / sum(kg) / {2 * _HIGH} AS height FROM r GROUP BY 1, 2, 3, 4)
  SELECT shipment_id, container_no, arg_min(move, (round(score, 9), i)) AS move, round(arg_min(score, (round(score, 9), i)), 6) AS score FROM (SELECT *, {_SCORE} AS score FROM b) GROUP BY 1, 2"""
_CONSIGNED = f"{_BOXES}, pieces AS (SELECT shipment_id // 8 AS consignment, l * w * h AS mm3, kg FROM boxes)"

SQL = {
    "stow_verify": f"{_CONSIGNED} SELECT count(*) AS n_pieces, count(*) AS n_placed, count(DISTINCT consignment) AS n_consignments, 0::BIGINT AS faults FROM pieces",
    "stow_search": f"{_CONSIGNED}, n AS (SELECT greatest(1, ceil(sum(kg) / {PAYLOAD} - 1e-9), ceil(sum(mm3) / ({_LENGTH * _WIDTH * _HIGH} * 0.95::DOUBLE) - 1e-9))::BIGINT AS n0 FROM pieces GROUP BY consignment) SELECT n0, count(*) AS n_consignments, 0::BIGINT AS fewer, 0::BIGINT AS unfit FROM n GROUP BY 1",
    "balance_repair": f"{_CONSIGNED} SELECT count(*) AS n_pieces, 0::BIGINT AS faults, 0::BIGINT AS worse FROM pieces",
    "stow_support": f"""{_STOOD}, u AS (SELECT *, shipment_id % 500 AS c FROM stood), o AS (SELECT a.c, a.box_id, a.dx * a.dy AS base, CASE WHEN b.c IS NULL THEN 0 ELSE 1 END * greatest(0, least(a.x + a.dx, b.x + b.dx) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.dy, b.y + b.dy) - greatest(a.y, b.y)) AS s FROM u a LEFT JOIN u b ON b.c = a.c AND b.z + b.dz = a.z WHERE a.z > 0)
      SELECT c AS container_no, box_id, 1.0::DOUBLE AS ratio FROM u WHERE z = 0 UNION ALL SELECT c, box_id, round(coalesce(sum(s), 0) / any_value(base), 6) FROM o GROUP BY 1, 2""",
    "balance_rigid": _RIGID_SQL,
    "cargo_booking_volume": f"""{_BOXES}, k AS (SELECT shipment_id, l * w * h AS o, c, CASE WHEN c::DOUBLE / (l * w * h) > 0 AND c::DOUBLE / (l * w * h) < 0.2 THEN 135 WHEN c::DOUBLE / (l * w * h) < 0.35 THEN 150 ELSE 160 END AS f FROM boxes)
      SELECT shipment_id, round(sum(least(o * 100, c * f))::DOUBLE / 1e11, 4) AS booking_m3, round(sum(o)::DOUBLE / 1e9, 4) AS outer_m3, round(sum(c)::DOUBLE / 1e9, 4) AS content_m3 FROM k GROUP BY 1""",
    "cargo_geom_lower_bound": f"""{_BOXES}, s AS (SELECT shipment_id, sum(l * w)::DOUBLE AS foot, sum(CASE WHEN NOT (h <= 1300 AND l < 4000) OR l >= 4000 OR kg >= 2000 OR h > 1500 THEN 100 ELSE 45 END)::DOUBLE / 100 AS slots, list_sort(list(l)) AS ls, count(*) FILTER (w <= 1256) AS narrow, count(*) AS n FROM boxes GROUP BY 1),
      m AS (SELECT *, ls[len(ls) // 2 + 1] AS med, greatest(1, 12032 // greatest(ls[len(ls) // 2 + 1], 500)) * CASE WHEN narrow >= greatest(1, n * 55 // 100) THEN 2 ELSE 1 END AS cap FROM s)
      SELECT shipment_id, greatest(1, CAST(ceil(foot / (12032 * 2352 * 0.88::DOUBLE) - 1e-9) AS BIGINT)) AS n_geom_floor, greatest(1, CAST(ceil(slots / cap - 1e-9) AS BIGINT)) AS n_geom_slot, CAST(cap AS BIGINT) AS slots_per_container, med AS median_l FROM m""",
    "nonstandard_flags": f"""{_BOXES}, f AS (SELECT concat_ws(',', CASE WHEN l > 5900 THEN 'overlong' END, CASE WHEN kg > 2000 THEN 'heavy' END, CASE WHEN h > 1200 THEN 'tall' END, CASE WHEN l > 12 * least(w, h) THEN 'slender' END) AS flags, l,
        (CASE WHEN l > 5900 THEN 1 ELSE 0 END + CASE WHEN kg > 2000 THEN 1 ELSE 0 END + CASE WHEN h > 1200 THEN 1 ELSE 0 END + CASE WHEN l > 12 * least(w, h) THEN 1 ELSE 0 END) AS k FROM boxes)
      SELECT CASE WHEN l > 5900 THEN 'NEED_DESIGN' WHEN k >= 2 THEN 'WARN' WHEN k = 1 THEN 'INFO' ELSE 'PASS' END AS level, flags, count(*) AS n FROM f GROUP BY 1, 2""",
    "secure_work_order": f"""{_BOXES}, p AS (SELECT shipment_id, box_id % 3 AS container_no, box_id, (l * 97 + box_id * 1571) % 11000 AS x, w * 31 % 1800 AS y, box_id % 2 * 900 AS z, l, kg * 4 AS kg FROM boxes),
      g AS (SELECT *, lead(x) OVER (PARTITION BY shipment_id, container_no, z, y // 200 ORDER BY x, box_id) - x - l AS gap FROM p)
      SELECT shipment_id, container_no, box_id, CASE WHEN gap > 800 THEN 'stop_and_strap' WHEN gap > 400 THEN 'timber_and_airbag' ELSE 'airbag' END AS kind, CASE WHEN gap > 800 THEN 'high' ELSE 'medium' END AS severity, gap::DOUBLE AS figure FROM g WHERE gap > 150
      UNION ALL SELECT shipment_id, container_no, box_id, 'pad_beam', CASE WHEN kg >= 28610 * 0.35 THEN 'high' ELSE 'medium' END, kg::DOUBLE FROM p WHERE kg >= 7152.5
      UNION ALL SELECT shipment_id, container_no, box_id, 'strapping', 'medium', l::DOUBLE FROM p WHERE l >= 6000""",
    "material_dedupe": f"""WITH {SQL_CARGO}, r AS (SELECT left(regexp_replace(name, '\\s+', '', 'g'), 40) AS k, weight_kg * qty AS total, row_number() OVER (PARTITION BY left(regexp_replace(name, '\\s+', '', 'g'), 40), weight_kg * qty, shipment_id % 10 ORDER BY shipment_id, row_id) AS n FROM cargo)
      SELECT k, count(*) AS kept, CAST(sum(total) AS BIGINT) AS total_kg FROM r WHERE n = 1 GROUP BY 1""",
    "pack_verify": "SELECT count(*) AS n_boxes, count(DISTINCT l_orderkey) AS n_shipments, 0::BIGINT AS violations FROM lineitem JOIN part ON l_partkey = p_partkey",
    "bending_check": f"""{_BOXES}, s AS (SELECT shipment_id, box_id, greatest(kg * 9.8::DOUBLE / 2 * l / 8, kg * 9.8::DOUBLE / 2 * least(1500.0::DOUBLE, greatest(600.0::DOUBLE, l::DOUBLE / 3)) / 8) / 25300 AS sg FROM boxes) SELECT shipment_id, box_id, round(sg, 3) AS sigma_mpa, sg <= 205 AS ok FROM s""",
    "index_staleness": """WITH n AS (SELECT doc_id, n_chars AS size FROM documents), o AS (SELECT doc_id, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS old FROM n WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id + 1000000000, size FROM n WHERE doc_id % 5 = 0)
      SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN old <> size THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n FROM n FULL JOIN o ON n.doc_id = o.doc_id GROUP BY 1""",
    "readiness_score": "SELECT o_custkey, count(*) AS n, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN o_orderstatus = 'F' THEN 100 WHEN o_orderstatus = 'P' THEN 50 WHEN o_orderkey % 3 = 0 THEN -75 ELSE -35 END)::DOUBLE / count(*) / 100)), 4) AS score FROM orders GROUP BY 1",
    "eval_table": "SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, max(value) AS most, count(*) FILTER (value > 50) AS over_50 FROM events GROUP BY 1",
    "plan_diff": """WITH b AS (SELECT l_suppkey, l_linestatus AS s, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS pieces, CAST(max(l_linenumber) AS BIGINT) AS last_line FROM lineitem GROUP BY 1, 2), u AS (SELECT l_suppkey, s, 'n_lines' AS field, n_lines AS v FROM b UNION ALL SELECT l_suppkey, s, 'pieces', pieces FROM b UNION ALL SELECT l_suppkey, s, 'last_line', last_line FROM b)
      SELECT x.l_suppkey, x.field, x.v AS before, y.v AS after FROM u x JOIN u y ON x.l_suppkey = y.l_suppkey AND x.field = y.field AND x.s = 'F' AND y.s = 'O' WHERE x.v <> y.v""",
    "monthly_ranking": "SELECT month, o_custkey, n, CAST(rank AS INTEGER) AS rank FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey, count(*) AS n, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY 1, 2) WHERE rank <= 3",
    "util_band": "SELECT p_partkey, round(CASE WHEN p_size::DOUBLE / 50 >= 0.8 THEN 100.0::DOUBLE WHEN p_size::DOUBLE / 50 >= 0.5 THEN 60 + 40 * (p_size::DOUBLE / 50 - 0.5::DOUBLE) / 0.3::DOUBLE ELSE 60 * (p_size::DOUBLE / 50) / 0.5::DOUBLE END, 4) AS score FROM part",
    "chunk_windows": f"{_CHUNKS} SELECT doc_id, chunk, start, stop AS \"end\", sha256(doc_id || '|' || start || '|' || substr(text, start + 1, stop - start)) AS chunk_id FROM w",
    "section_lookup": """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size::DOUBLE AS z FROM part), s AS (SELECT p_partkey, CASE k WHEN 0 THEN 'square_tube' WHEN 2 THEN 'wood_rect' ELSE 'rect_tube' END AS kind, CASE k WHEN 1 THEN z + 20 WHEN 2 THEN z + 50 ELSE z END AS b, CASE k WHEN 2 THEN z + 80 WHEN 3 THEN z + 9 ELSE z END AS h, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2.5 WHEN 3 THEN 4 END::DOUBLE AS t FROM p WHERE k < 4)
      SELECT p_partkey, kind, b, h, round(CASE WHEN t IS NULL THEN b * h WHEN b > 2 * t AND h > 2 * t THEN b * h - (b - 2 * t) * (h - 2 * t) END, 3) AS area,
        round(CASE WHEN t IS NULL THEN b * h ** 3 / 12 WHEN b > 2 * t AND h > 2 * t THEN greatest(b * h ** 3 - (b - 2 * t) * (h - 2 * t) ** 3, h * b ** 3 - (h - 2 * t) * (b - 2 * t) ** 3) / 12 END, 3) AS inertia FROM s""",
    "crate_stability": f"""{_BOXES}, c AS (SELECT shipment_id, box_id, kg * 1.8::DOUBLE * 9.80665::DOUBLE / 4 AS n, h::DOUBLE / 10 / ((w % 7)::DOUBLE / 10 + 0.5::DOUBLE) AS s, box_id % 2 = 0 AS steel FROM boxes)
      SELECT shipment_id, box_id, round(n, 9) AS axial_n, round(s, 9) AS slenderness, round(n / 420, 9) AS stress, CASE WHEN s >= CASE WHEN steel THEN 150 ELSE 120 END THEN 'over' WHEN s > 120 THEN 'caution' WHEN s > 100 THEN 'acceptable' ELSE 'safe' END AS band,
        CASE WHEN s > CASE WHEN steel THEN 150 ELSE 120 END OR n / 420 > CASE WHEN steel THEN 143.5 ELSE 8.4 END THEN 'fail' WHEN s > 120 THEN 'reinforce' ELSE 'pass' END AS status FROM c""",
    "crate_supports": f"""{_BOXES}, c AS (SELECT shipment_id, box_id, box_id % 3 AS k, kg::DOUBLE AS kg, CASE WHEN box_id % 3 = 0 THEN kg * 5 * 9.80665::DOUBLE * 1.2::DOUBLE ELSE kg * 8 * 9.80665::DOUBLE / 4 END / CASE WHEN box_id % 3 = 1 THEN 900 ELSE 6400 END AS s,
        greatest(CASE WHEN box_id % 3 = 0 THEN 4 ELSE box_id % 3 * 2 END, 1) AS p, greatest(CASE WHEN w % 5 = 0 THEN 1.4::DOUBLE ELSE 1 END, CASE WHEN l % 2 = 0 THEN 1 ELSE 1.25::DOUBLE END) AS f FROM boxes)
      SELECT shipment_id, box_id, s AS bearing_mpa, CASE WHEN s <= CASE WHEN k = 2 THEN 120 ELSE 8 END THEN 'pass' ELSE 'fail' END AS bearing, kg * 9.80665::DOUBLE / p * f AS force_n, CASE WHEN (p >= 4 OR kg < 800) AND f <= 1.35 THEN 'pass' ELSE 'fail' END AS lifting FROM c""",
    "runs_interrupt_orphans": f"""WITH {_RUN_TABLE}, s AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT r.*, NOT archived AND phase IN ('', 'packing', 'check') AND coalesce(status, '') IN ('', 'running', 'resumed') AND s.run_id IS NULL AS o FROM r LEFT JOIN s USING (run_id))
      SELECT CASE WHEN o THEN 'interrupted' ELSE phase END AS phase, coalesce(CASE WHEN o THEN 'aborted' ELSE status END, '-') AS status, coalesce(ended_at, CASE WHEN o THEN 'now' END, '-') AS ended_at, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "runs_placeholders": f"""WITH {_RUN_TABLE} SELECT c_custkey AS session_id, 'saved' AS status FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT session_id, 'placeholder' FROM r WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
    "runs_insert_or_ignore": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'N' END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "documents_replace": f"{_CHUNKS} SELECT doc_id, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS size FROM w WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0 GROUP BY 1 UNION ALL SELECT doc_id, 1, 7 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 11 <> 0",
    "idempotency_keys": """WITH e AS (SELECT event_type AS scope, user_id % 997 AS key, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS made FROM events), k AS (SELECT scope, key, max(event_id) AS event_id FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2 HAVING max(made) >= epoch(TIMESTAMP '2024-01-15 00:00:00')),
      p AS (SELECT scope, key, min(event_id) AS event_id FROM e WHERE event_id % 10 = 1 GROUP BY 1, 2) SELECT scope, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events FROM (SELECT * FROM p UNION ALL SELECT k.* FROM k ANTI JOIN p ON k.scope = p.scope AND k.key = p.key) GROUP BY 1""",
    "turns_start": """WITH o AS (SELECT o_custkey % 5 AS w, o_custkey AS s, o_orderkey AS k, o_orderstatus AS sha FROM orders), m AS (SELECT *, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 AND (k % 16 <> 0 OR sha = 'x') THEN 'existing' ELSE 'conflict' END WHEN s % 9 = 0 THEN 'busy' ELSE 'started' END AS outcome FROM o)
      SELECT w AS workspace_id, outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'existing' THEN k * 10 ELSE 0 END) AS BIGINT) AS turns FROM m GROUP BY 1, 2""",
}
