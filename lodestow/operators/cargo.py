"""Volume, weight, container count, gates and balance of cargo rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import PACK_FACTORS

FILL = 0.82
MARGIN = 0.92


def solid_mm3() -> Column:
    return F.col("length_mm") * F.col("width_mm") * F.col("height_mm") * F.greatest("qty", F.lit(1))


def pack_factor(category: str | Column = "category") -> Column:
    """Hundredths, clamped to 105 to 180."""
    c = F.col(category) if isinstance(category, str) else category
    factor = F.coalesce(*(F.when(c == name, F.lit(f)) for name, f in PACK_FACTORS.items()), F.lit(PACK_FACTORS["general"]))
    return F.least(F.greatest(factor, F.lit(105)), F.lit(180))


def effective_volume(rows: DataFrame, *keys: str) -> DataFrame:
    """Piece and packed volume of each group, summed as whole cubic millimetres so that the order of rows plays no part."""
    sums = rows.groupBy(*keys).agg(F.sum(solid_mm3()).alias("solid"), F.sum(solid_mm3() * pack_factor()).alias("packed"))
    solid, packed = F.col("solid") / 1e9, F.col("packed") / 1e11
    return sums.select(*keys, F.round(solid, 4).alias("piece_solid_m3"), F.round(packed, 4).alias("pack_effective_m3"), F.when(solid > 1e-9, F.round(packed / solid, 3)).otherwise(1.0).alias("inflation_ratio"))


def units_needed(amount: Column, capacity: Column) -> Column:
    """0 for nothing, else the quotient rounded up with a hair of tolerance, 1 at least."""
    return F.when(amount > 0, F.greatest(F.lit(1), F.ceil(amount / capacity - 1e-9))).otherwise(F.lit(0)).cast("bigint")


def estimate_containers(rows: DataFrame, types: DataFrame, container_type: str = "40HQ", fill: float = FILL, *keys: str) -> DataFrame:
    """Containers by weight and by packed volume for each group, and which of the two binds."""
    fill = min(max(fill, 0.5), 0.9)
    sums = rows.groupBy(*keys).agg(F.sum(solid_mm3() * pack_factor()).alias("packed"), F.sum(F.col("weight_kg") * F.greatest("qty", F.lit(1))).alias("net"))
    spec = types.where(F.col("type") == container_type).select("payload_kg", "theory_m3")
    sums = sums.crossJoin(F.broadcast(spec))  # one row
    gross, volume = F.col("net") * 1.12, F.round(F.col("packed") / 1e11, 4)
    sums = sums.withColumn("gross", gross).withColumn("volume", volume)
    sums = sums.withColumn("by_weight", units_needed(F.col("gross"), F.col("payload_kg"))).withColumn("by_volume", units_needed(F.col("volume"), F.col("theory_m3") * fill))
    binding = F.when(F.col("by_weight") == F.col("by_volume"), "both").when(F.col("by_weight") > F.col("by_volume"), "weight").otherwise("volume")
    return sums.select(*keys, F.round("gross", 1).alias("gross_kg"), F.col("volume").alias("volume_m3"), F.col("by_weight").alias("containers_by_weight"), F.col("by_volume").alias("containers_by_volume"), F.greatest("by_weight", "by_volume").alias("containers_needed"), binding.alias("binding_constraint"))


def recommend_container(rows: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """The best of the container types for each group by fill, weight and penalties; equal scores keep the order 20GP, 40GP, 40HQ."""
    sums = rows.groupBy(key).agg(F.max("length_mm").alias("l"), F.max("height_mm").alias("h"), (F.sum(solid_mm3() * pack_factor())).alias("packed"), F.sum(F.col("weight_kg") * F.greatest("qty", F.lit(1))).alias("net"))
    each = sums.withColumn("v", F.round(F.col("packed") / 1e11, 4)).withColumn("w", F.col("net") * 1.15).crossJoin(F.broadcast(types))
    t, fill, heavy = F.col("type"), F.col("v") / F.col("practical_m3"), F.col("w") / F.col("payload_kg")
    dense = F.when(F.col("v") > 0.1, F.col("w") / F.col("v")).otherwise(0.0)
    each = each.where(~((t == "20GP") & ((F.col("l") > 5900) | ((F.col("l") >= 4000) & (F.col("w") >= 800)))) & ~((F.col("h") > 2350) & (t != "40HQ")))
    by_volume = F.when(fill < 0.25, 20 + fill * 80).when(fill > 1.05, 10).otherwise(100 - F.abs(fill - 0.65) * 80)
    by_weight = F.when(heavy > 1, 0).when((dense > 400) & (t == "20GP"), 95).when((dense < 150) & (t == "40HQ"), 90).otherwise(70 + F.least(heavy, F.lit(0.8)) * 30)
    one = F.when((fill <= 0.95) & (heavy <= 0.95), 30).otherwise(0)
    high = F.when((t == "40HQ") & (F.col("h") <= 2200) & (fill < 0.7), 8).otherwise(0)
    strained = (F.col("w") > F.col("payload_kg") * 0.95) & (F.col("v") > F.col("practical_m3") * 0.3)
    large = (F.col("w") / 28610 >= 3) | (F.col("w") >= 80000)
    extra = (
        F.when((t == "20GP") & (F.col("v") > 27.0 * 0.85), -35).otherwise(0)
        + F.when((t == "40GP") & (F.col("v") <= 56.0 * 0.9) & (F.col("l") <= 5800), 12).otherwise(0)
        + F.when(large & (t == "40HQ"), 28).when(large & (t == "40GP"), -12).otherwise(0)
    )
    score = by_volume * 0.45 + by_weight * 0.4 + one - high + F.when(strained, -25).otherwise(extra)
    ranked = each.withColumn("score", F.round(score, 6)).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "type")))
    top = ranked.where("n = 1")
    return top.select(key, F.when((F.col("w") >= 80000) & (t == "40GP"), "40HQ").otherwise(t).alias("recommended"), F.round("score", 3).alias("score"))


def infeasible(rows: DataFrame, types: DataFrame, container_type: str = "40HQ", margin: float = MARGIN) -> DataFrame:
    """Rows of which a single piece is over the safe payload."""
    spec = types.where(F.col("type") == container_type).select((F.col("payload_kg") * margin).alias("cap_kg"))
    return rows.crossJoin(F.broadcast(spec)).where((F.col("weight_kg") > F.col("cap_kg") + 1e-6) | ((F.col("weight_kg") * F.col("qty") > F.col("cap_kg") + 1e-6) & (F.col("qty") <= 1)))


def oversize(rows: DataFrame, types: DataFrame, container_type: str) -> DataFrame:
    """Rows whose sorted edges exceed the sorted inner edges of the container: they fit no way round."""
    edges = rows.withColumn("edges", F.sort_array(F.array("length_mm", "width_mm", "height_mm"))).crossJoin(F.broadcast(inner_edges(types, container_type)))
    return edges.where(F.exists(F.zip_with("edges", "inner", lambda a, b: a > b + 1e-6), lambda x: x))


def inner_edges(types: DataFrame, container_type: str) -> DataFrame:
    """(inner): the sorted inner edges of a type of container, one row."""
    return types.where(F.col("type") == container_type).select(F.sort_array(F.array("inner_l", "inner_w", "inner_h")).alias("inner"))


def centre_of_gravity(layout: DataFrame, boxes: DataFrame, length: float, width: float, height: float, *keys: str) -> DataFrame:
    """Centre of mass, share of mass in the middle half, and balance class of each container.

    layout(keys, box_id, x, y, z, dx, dy, dz), boxes(keys, box_id, gross_weight_kg). A box without a weight weighs its volume in litres.
    """
    placed = layout.join(boxes, [*keys, "box_id"], "left")
    m = F.coalesce(F.when(F.col("gross_weight_kg") > 0, F.col("gross_weight_kg")), F.col("dx") * F.col("dy") * F.col("dz") / 1e6)
    cx, cy, cz = (F.col(a) * 2 + F.greatest("d" + a, F.lit(1)) for a in "xyz")  # twice the centre: whole numbers
    middle = (cx >= 0.5 * length) & (cx <= 1.5 * length)
    sums = placed.groupBy(*keys).agg(F.sum(m).alias("m"), *(F.sum(m * c).alias("m" + a) for a, c in zip("xyz", (cx, cy, cz), strict=True)), F.sum(F.when(middle, m).otherwise(0)).alias("mid"), F.count("*").alias("item_count"))
    gx, gy, gz = (F.col("m" + a) / F.col("m") / 2 for a in "xyz")
    out = sums.withColumns({"gx": gx, "gy": gy, "gz": gz}).withColumns({"lat": F.abs(F.col("gy") - width / 2) / (width / 2), "long": F.col("gx") / length, "tall": F.col("gz") / height, "half": F.col("mid") / F.col("m")})
    lat, long_, half, tall = (F.col(c) for c in ("lat", "long", "half", "tall"))
    balance = (
        F.when((lat >= 0.15) | (long_ < 0.25) | (long_ > 0.75) | (half < 0.4), "block")
        .when((lat >= 0.1) | (long_ < 0.35) | (long_ > 0.65) | (half < 0.6) | (tall > 0.55), F.when((lat >= 0.1) | (half < 0.5), "warn_high").otherwise("warn"))
        .when((lat >= 0.05) | ~long_.between(0.4, 0.6), "warn")
        .otherwise("ok")
    )
    return out.select(*keys, "item_count", F.round("gx", 1).alias("gx_mm"), F.round("gy", 1).alias("gy_mm"), F.round("gz", 1).alias("gz_mm"), F.round("lat", 4).alias("lateral_eccentricity"), F.round("long", 4).alias("longitudinal_position"), F.round("tall", 4).alias("height_ratio"), F.round("half", 4).alias("mass_in_mid50_ratio"), balance.alias("balance"))


def heavy_on_top(layout: DataFrame, *keys: str) -> DataFrame:
    """(keys, total_kg, heavy_kg, ratio): the mass of boxes over 1.25 times the mean mass of the boxes that they rest on, and its share.

    layout(keys, box_id, x, y, z, dx, dy, dz, kg). A box rests on those whose top is its underside and whose outline it overlaps, at any level.
    """
    below = layout.select(*keys, (F.col("z") + F.col("dz")).alias("z"), *(F.col(c).alias("b_" + c) for c in ("x", "y", "dx", "dy", "kg")))
    on = layout.where("z > 0 AND kg > 0").join(below, [*keys, "z"])
    for a in "xy":
        on = on.where((F.col(a) < F.col(f"b_{a}") + F.col(f"b_d{a}")) & (F.col(f"b_{a}") < F.col(a) + F.col(f"d{a}")))
    each = on.groupBy(*keys, "box_id", "kg").agg(F.sum("b_kg").alias("under"), F.count("*").alias("n"))
    heavy = each.where((F.col("under") > 0) & (F.col("kg") * F.col("n") * 4 > F.col("under") * 5)).groupBy(*keys).agg(F.sum("kg").alias("heavy_kg"))
    totals = layout.groupBy(*keys).agg(F.sum("kg").alias("total_kg")).join(heavy, [*keys], "left").withColumn("heavy_kg", F.coalesce("heavy_kg", F.lit(0)))
    total = F.when(F.col("total_kg") > 0, F.col("total_kg")).otherwise(1)
    return totals.select(*keys, "total_kg", "heavy_kg", F.round(F.col("heavy_kg") / total, 6).alias("ratio"))


def load_sequence(layout: DataFrame, *keys: str) -> DataFrame:
    """Loading steps of each container: lower boxes first, then from the far end to the door, then by side."""
    order = Window.partitionBy(*keys).orderBy("z", F.desc("x"), "y", "box_id")
    return layout.withColumn("step", F.row_number().over(order))


def vgm_draft(boxes: DataFrame, types: DataFrame, counts: DataFrame, container_type: str, key: str, packaging: float = 0.02, dunnage: float = 80.0, decimals: int = 1) -> DataFrame:
    """A weight draft for each container: cargo shared evenly, packaging, dunnage and tare added. counts(key, n)."""
    sums = boxes.groupBy(key).agg(F.sum("gross_weight_kg").alias("cargo")).join(counts, key)
    spec = types.where(F.col("type") == container_type).select("tare_kg")
    each = sums.crossJoin(F.broadcast(spec)).withColumn("container_no", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int"))))
    per = F.col("cargo") / F.greatest("n", F.lit(1))
    return each.select(key, "container_no", F.round(per, decimals).alias("cargo_kg"), F.round(per * packaging, decimals).alias("packaging_kg"), F.lit(dunnage).alias("dunnage_kg"), "tare_kg", F.round(per * (1 + packaging) + dunnage + F.col("tare_kg"), decimals).alias("vgm_kg"))


def consolidate(items: DataFrame, key: str, order: str, length: str, capacity: int) -> DataFrame:
    """Greedy along one axis: an item that does not fit is skipped and the cursor stays, so this is a fold, not a running sum."""
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("bigint").alias("l")))).alias("xs"))
    fold = F.expr(f"aggregate(xs, named_struct('at', 0L, 'n', 0L), (a, x) -> IF(a.at + x.l <= {capacity}, named_struct('at', a.at + x.l, 'n', a.n + 1), a))")
    return rows.select(key, fold.alias("f"), F.size("xs").cast("bigint").alias("n_items")).select(key, "n_items", F.col("f.n").alias("placed"), F.col("f.at").alias("used_mm"))
