"""Cargo queries over the driver's tables, each with the SQL that states the same result on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cargo as ops
from ..operators.statistics import upper_median
from .tables import SQL_CARGO, SQL_CONTAINERS, SQL_FACTOR, cargo, containers

_WITH = f"WITH {SQL_CARGO}, {SQL_CONTAINERS}"
_PACKED = f"length_mm * width_mm * height_mm * greatest(qty, 1) * least(greatest({SQL_FACTOR}, 105), 180)"
_SOLID = "length_mm * width_mm * height_mm * greatest(qty, 1)"


def cargo_effective_volume(spark: SparkSession, d: str) -> DataFrame:
    return ops.effective_volume(cargo(spark, d), "shipment_id")


def cargo_container_estimate(spark: SparkSession, d: str) -> DataFrame:
    return ops.estimate_containers(cargo(spark, d), containers(spark), "40HQ", ops.FILL, "shipment_id")


def cargo_recommend_container(spark: SparkSession, d: str) -> DataFrame:
    return ops.recommend_container(cargo(spark, d), containers(spark), "shipment_id")


def cargo_feasibility(spark: SparkSession, d: str) -> DataFrame:
    rows = cargo(spark, d).withColumn("weight_kg", F.col("weight_kg") * 12)
    return ops.infeasible(rows, containers(spark)).select("shipment_id", "row_id", "qty", F.col("weight_kg").cast("bigint").alias("unit_kg"), F.round("cap_kg", 1).alias("cap_kg"))


def gate_oversize(spark: SparkSession, d: str) -> DataFrame:
    rows = cargo(spark, d).withColumn("height_mm", F.col("height_mm") * 2 + 100)
    return ops.oversize(rows, containers(spark), "20GP").select("shipment_id", "row_id", "length_mm", "width_mm", "height_mm")


def category_guess(spark: SparkSession, d: str) -> DataFrame:
    rows = cargo(spark, d)
    thin, wide = F.least("width_mm", "height_mm"), F.greatest("width_mm", "height_mm")
    guess = F.when((F.col("length_mm") >= 2000) & (wide <= 300), "steel").when((thin <= 250) & (wide >= 800), "aluminum_panel").otherwise("general")
    return rows.groupBy(guess.alias("guess")).agg(F.count("*").alias("n"), F.sum("qty").alias("pieces"))


def cargo_profile(spark: SparkSession, d: str) -> DataFrame:
    """Family histogram of each shipment with its leading family (ties: first by name)."""
    each = cargo(spark, d).groupBy("shipment_id", "category").agg(F.count("*").alias("n"))
    return each.groupBy("shipment_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_families"), F.min(F.struct(-F.col("n"), "category")).alias("top")).select("shipment_id", "n_rows", "n_families", F.col("top.category").alias("leading"), F.round(-F.col("top.col1") / F.col("n_rows"), 4).alias("leading_share"))


def unit_infer_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """Length scale of each part family from the upper median: values of 25 or less are metres."""
    raw = F.when(F.col("part_no") % 3 == 0, F.col("length_mm") / 1000).otherwise(F.col("length_mm").cast("double"))
    rows = cargo(spark, d).select("supplier_id", (F.col("part_no") % 3).alias("grp"), raw.alias("raw"))
    return upper_median(rows, ["supplier_id", "grp"], F.col("raw")).withColumn("unit", F.when(F.col("upper_median") <= 25, "m").otherwise("mm"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    """A layout by whole-number rules: a container of each shipment takes every third row."""
    rows = cargo(spark, d)
    place = [((F.col("part_no") * 97 + F.col("row_id") * 1571) % 11000).alias("x"), (F.col("part_no") * 31 % 1800).alias("y"), (F.col("row_id") % 2 * 900).alias("z")]
    return rows.select("shipment_id", (F.col("row_id") % 3).alias("container_no"), F.col("row_id").alias("box_id"), *place, F.col("length_mm").alias("dx"), F.col("width_mm").alias("dy"), F.col("height_mm").alias("dz"), "weight_kg")


_LAYOUT = """layout AS (SELECT shipment_id, row_id % 3 AS container_no, row_id AS box_id, (part_no * 97 + row_id * 1571) % 11000 AS x, part_no * 31 % 1800 AS y, row_id % 2 * 900 AS z,
  length_mm AS dx, width_mm AS dy, height_mm AS dz, weight_kg FROM cargo)"""


def cog_by_container(spark: SparkSession, d: str) -> DataFrame:
    layout = _layout(spark, d)
    boxes = layout.select("shipment_id", "container_no", "box_id", F.col("weight_kg").alias("gross_weight_kg"))
    return ops.centre_of_gravity(layout.drop("weight_kg"), boxes, 12032, 2352, 2698, "shipment_id", "container_no")


def load_sequence(spark: SparkSession, d: str) -> DataFrame:
    return ops.load_sequence(_layout(spark, d), "shipment_id", "container_no").select("shipment_id", "container_no", "box_id", F.col("step").cast("bigint").alias("step"))


def layout_gap_lag(spark: SparkSession, d: str) -> DataFrame:
    """Gap to the next box in the same band of 200 mm: where a void over 150 mm is left."""
    w = Window.partitionBy("shipment_id", "container_no", "z", (F.col("y") / 200).cast("bigint")).orderBy("x", "box_id")
    gap = F.lead("x").over(w) - F.col("x") - F.col("dx")
    return _layout(spark, d).withColumn("gap_mm", gap).where("gap_mm > 150").select("shipment_id", "container_no", "box_id", "gap_mm", F.when(F.col("gap_mm") > 800, "block").when(F.col("gap_mm") > 400, "airbag").otherwise("pad").alias("fill"))


def heavy_on_top(spark: SparkSession, d: str) -> DataFrame:
    """Three levels: most boxes are 900 mm high and carry the next; a lower one carries nothing, as its top meets no underside."""
    high = F.when(F.col("dx") % 5 == 0, 850).otherwise(900)
    layout = _layout(spark, d).withColumns({"z": F.col("box_id") % 4 * 900, "dz": high}).withColumnRenamed("weight_kg", "kg")
    return ops.heavy_on_top(layout, "shipment_id", "container_no")


def layout_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes of one container that share space."""
    a, b = _layout(spark, d).alias("a"), _layout(spark, d).alias("b")
    meet = [(F.col(f"a.{p}") < F.col(f"b.{p}") + F.col(f"b.d{p}")) & (F.col(f"b.{p}") < F.col(f"a.{p}") + F.col(f"a.d{p}")) for p in "xyz"]
    on = (F.col("a.shipment_id") == F.col("b.shipment_id")) & (F.col("a.container_no") == F.col("b.container_no")) & (F.col("a.box_id") < F.col("b.box_id")) & meet[0] & meet[1] & meet[2]
    return a.join(b, on).select("a.shipment_id", "a.container_no", F.col("a.box_id").alias("box_a"), F.col("b.box_id").alias("box_b"))


def vgm_draft(spark: SparkSession, d: str) -> DataFrame:
    rows = cargo(spark, d)
    counts = ops.estimate_containers(rows, containers(spark), "40HQ", ops.FILL, "shipment_id").select("shipment_id", F.col("containers_needed").alias("n"))
    boxes = rows.select("shipment_id", (F.col("weight_kg") * F.col("qty")).cast("double").alias("gross_weight_kg"))
    return ops.vgm_draft(boxes, containers(spark), counts, "40HQ", "shipment_id", decimals=6)


def consolidate_greedy(spark: SparkSession, d: str) -> DataFrame:
    return ops.consolidate(cargo(spark, d), "shipment_id", "row_id", "length_mm", 12032)


def manifest_by_part(spark: SparkSession, d: str) -> DataFrame:
    rows = cargo(spark, d)
    return rows.groupBy("part_no").agg(F.sum("qty").alias("pieces"), F.sum(F.col("qty") * F.col("weight_kg")).alias("net_kg"), F.count_distinct("shipment_id").alias("n_shipments"), F.concat_ws(",", F.transform(F.sort_array(F.collect_set("supplier_id")), lambda x: x.cast("string"))).alias("suppliers"))


def manifest_by_container(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d).groupBy("shipment_id", "container_no").agg(F.count("*").alias("n_boxes"), F.sum("weight_kg").alias("weight_kg"), F.max("z").alias("top_z"))


def split_by_net_cap(spark: SparkSession, d: str) -> DataFrame:
    """Units over 1,000 kg become equal parts of whole kilograms, the last part takes the rest."""
    rows = cargo(spark, d).where("weight_kg > 1000").withColumn("parts", F.ceil(F.col("weight_kg") / 1000).cast("int"))
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(1), "parts"))).withColumn("share", (F.col("weight_kg") / F.col("parts")).cast("bigint"))
    kg = F.when(F.col("part") == F.col("parts"), F.col("weight_kg") - F.col("share") * (F.col("parts") - 1)).otherwise(F.col("share"))
    return each.select("shipment_id", "row_id", "part", kg.cast("bigint").alias("part_kg"))


QUERIES = {
    f.__name__: f
    for f in (
        cargo_effective_volume, cargo_container_estimate, cargo_recommend_container, cargo_feasibility, gate_oversize, category_guess, cargo_profile, unit_infer_upper_median, cog_by_container,
        load_sequence, layout_gap_lag, heavy_on_top, layout_overlaps, vgm_draft, consolidate_greedy, manifest_by_part, manifest_by_container, split_by_net_cap,
    )
}

_ESTIMATE = f"""est AS (SELECT *, CASE WHEN gross > 0 THEN greatest(1, CAST(ceil(gross / 28610.0 - 1e-9) AS BIGINT)) ELSE 0 END AS bw, CASE WHEN volume > 0 THEN greatest(1, CAST(ceil(volume / (76.4::DOUBLE * 0.82::DOUBLE) - 1e-9) AS BIGINT)) ELSE 0 END AS bv
  FROM (SELECT shipment_id, sum(weight_kg * greatest(qty, 1))::DOUBLE * 1.12::DOUBLE AS gross, round(sum({_PACKED})::DOUBLE / 1e11, 4) AS volume FROM cargo GROUP BY 1))"""
SQL = {
    "cargo_effective_volume": f"""{_WITH} SELECT shipment_id, round(s / 1e9, 4) AS piece_solid_m3, round(p / 1e11, 4) AS pack_effective_m3, CASE WHEN s / 1e9 > 1e-9 THEN round((p / 1e11) / (s / 1e9), 3) ELSE 1.0 END AS inflation_ratio
      FROM (SELECT shipment_id, sum({_SOLID})::DOUBLE AS s, sum({_PACKED})::DOUBLE AS p FROM cargo GROUP BY 1)""",
    "cargo_container_estimate": f"""{_WITH}, {_ESTIMATE} SELECT shipment_id, round(gross, 1) AS gross_kg, volume AS volume_m3, bw AS containers_by_weight, bv AS containers_by_volume, greatest(bw, bv) AS containers_needed,
      CASE WHEN bw = bv THEN 'both' WHEN bw > bv THEN 'weight' ELSE 'volume' END AS binding_constraint FROM est""",
    "cargo_recommend_container": f"""{_WITH}, s AS (SELECT shipment_id, max(length_mm) AS l, max(height_mm) AS h, round(sum({_PACKED})::DOUBLE / 1e11, 4) AS v, sum(weight_kg * greatest(qty, 1))::DOUBLE * 1.15::DOUBLE AS w FROM cargo GROUP BY 1),
      e AS (SELECT s.*, type, v / practical_m3::DOUBLE AS fill, w / payload_kg::DOUBLE AS heavy, CASE WHEN v > 0.1 THEN w / v ELSE 0 END AS dense, practical_m3::DOUBLE AS pm, payload_kg::DOUBLE AS pk FROM s, containers
        WHERE NOT (type = '20GP' AND (l > 5900 OR (l >= 4000 AND w >= 800))) AND NOT (h > 2350 AND type <> '40HQ')),
      r AS (SELECT shipment_id, w, type, round((CASE WHEN fill < 0.25 THEN 20 + fill * 80 WHEN fill > 1.05 THEN 10 ELSE 100 - abs(fill - 0.65::DOUBLE) * 80 END) * 0.45::DOUBLE
        + (CASE WHEN heavy > 1 THEN 0 WHEN dense > 400 AND type = '20GP' THEN 95 WHEN dense < 150 AND type = '40HQ' THEN 90 ELSE 70 + least(heavy, 0.8::DOUBLE) * 30 END) * 0.4::DOUBLE
        + (CASE WHEN fill <= 0.95 AND heavy <= 0.95 THEN 30 ELSE 0 END) - (CASE WHEN type = '40HQ' AND h <= 2200 AND fill < 0.7 THEN 8 ELSE 0 END)
        + (CASE WHEN w > pk * 0.95::DOUBLE AND v > pm * 0.3::DOUBLE THEN -25 ELSE (CASE WHEN type = '20GP' AND v > 27.0::DOUBLE * 0.85::DOUBLE THEN -35 ELSE 0 END) + (CASE WHEN type = '40GP' AND v <= 56.0::DOUBLE * 0.9::DOUBLE AND l <= 5800 THEN 12 ELSE 0 END)
          + (CASE WHEN (w / 28610 >= 3 OR w >= 80000) AND type = '40HQ' THEN 28 WHEN (w / 28610 >= 3 OR w >= 80000) AND type = '40GP' THEN -12 ELSE 0 END) END), 6) AS score FROM e)
      SELECT shipment_id, CASE WHEN w >= 80000 AND type = '40GP' THEN '40HQ' ELSE type END AS recommended, round(score, 3) AS score FROM r QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY score DESC, type) = 1""",
    "cargo_feasibility": f"""{_WITH} SELECT shipment_id, row_id, qty, weight_kg * 12 AS unit_kg, round(28610.0::DOUBLE * 0.92::DOUBLE, 1) AS cap_kg FROM cargo
      WHERE weight_kg * 12 > 28610.0::DOUBLE * 0.92::DOUBLE + 1e-6 OR (weight_kg * 12 * qty > 28610.0::DOUBLE * 0.92::DOUBLE + 1e-6 AND qty <= 1)""",
    "gate_oversize": f"""{_WITH}, c AS (SELECT shipment_id, row_id, length_mm, width_mm, height_mm * 2 + 100 AS height_mm FROM cargo), s AS (SELECT *, list_sort([length_mm, width_mm, height_mm]) AS e FROM c)
      SELECT shipment_id, row_id, length_mm, width_mm, height_mm FROM s WHERE e[1] > 2352 OR e[2] > 2385 OR e[3] > 5898""",
    "category_guess": f"""{_WITH} SELECT CASE WHEN length_mm >= 2000 AND greatest(width_mm, height_mm) <= 300 THEN 'steel' WHEN least(width_mm, height_mm) <= 250 AND greatest(width_mm, height_mm) >= 800 THEN 'aluminum_panel' ELSE 'general' END AS guess,
      count(*) AS n, CAST(sum(qty) AS BIGINT) AS pieces FROM cargo GROUP BY 1""",
    "cargo_profile": f"""{_WITH}, e AS (SELECT shipment_id, category, count(*) AS n FROM cargo GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY shipment_id) AS t, count(*) OVER (PARTITION BY shipment_id) AS f, row_number() OVER (PARTITION BY shipment_id ORDER BY n DESC, category) AS k FROM e)
      SELECT shipment_id, CAST(t AS BIGINT) AS n_rows, f AS n_families, category AS leading, round(n::DOUBLE / t::DOUBLE, 4) AS leading_share FROM r WHERE k = 1""",
    "unit_infer_upper_median": f"""{_WITH}, r AS (SELECT supplier_id, part_no % 3 AS grp, CASE WHEN part_no % 3 = 0 THEN length_mm::DOUBLE / 1000 ELSE length_mm::DOUBLE END AS raw FROM cargo), s AS (SELECT supplier_id, grp, list_sort(list(raw)) AS xs FROM r GROUP BY 1, 2)
      SELECT supplier_id, grp, CAST(len(xs) AS BIGINT) AS n, xs[len(xs) // 2 + 1] AS upper_median, CASE WHEN xs[len(xs) // 2 + 1] <= 25 THEN 'm' ELSE 'mm' END AS unit FROM s""",
    "cog_by_container": f"""{_WITH}, {_LAYOUT}, c AS (SELECT shipment_id, container_no, weight_kg AS m, 2 * x + greatest(dx, 1) AS cx, 2 * y + greatest(dy, 1) AS cy, 2 * z + greatest(dz, 1) AS cz FROM layout),
      g AS (SELECT shipment_id, container_no, count(*) AS item_count, sum(m * cx)::DOUBLE / sum(m)::DOUBLE / 2 AS gx, sum(m * cy)::DOUBLE / sum(m)::DOUBLE / 2 AS gy, sum(m * cz)::DOUBLE / sum(m)::DOUBLE / 2 AS gz, sum(CASE WHEN cx BETWEEN 6016 AND 18048 THEN m ELSE 0 END)::DOUBLE / sum(m)::DOUBLE AS half FROM c GROUP BY 1, 2),
      k AS (SELECT *, abs(gy - 1176) / 1176 AS lat, gx / 12032 AS lon, gz / 2698 AS tall FROM g)
      SELECT shipment_id, container_no, item_count, round(gx, 1) AS gx_mm, round(gy, 1) AS gy_mm, round(gz, 1) AS gz_mm, round(lat, 4) AS lateral_eccentricity, round(lon, 4) AS longitudinal_position, round(tall, 4) AS height_ratio, round(half, 4) AS mass_in_mid50_ratio,
        CASE WHEN lat >= 0.15 OR lon < 0.25 OR lon > 0.75 OR half < 0.4 THEN 'block' WHEN lat >= 0.1 OR lon < 0.35 OR lon > 0.65 OR half < 0.6 OR tall > 0.55 THEN CASE WHEN lat >= 0.1 OR half < 0.5 THEN 'warn_high' ELSE 'warn' END
          WHEN lat >= 0.05 OR lon NOT BETWEEN 0.4 AND 0.6 THEN 'warn' ELSE 'ok' END AS balance FROM k""",
    "load_sequence": f"{_WITH}, {_LAYOUT} SELECT shipment_id, container_no, box_id, row_number() OVER (PARTITION BY shipment_id, container_no ORDER BY z, x DESC, y, box_id) AS step FROM layout",
    "layout_gap_lag": f"""{_WITH}, {_LAYOUT}, g AS (SELECT *, lead(x) OVER (PARTITION BY shipment_id, container_no, z, y // 200 ORDER BY x, box_id) - x - dx AS gap_mm FROM layout)
      SELECT shipment_id, container_no, box_id, gap_mm, CASE WHEN gap_mm > 800 THEN 'block' WHEN gap_mm > 400 THEN 'airbag' ELSE 'pad' END AS fill FROM g WHERE gap_mm > 150""",
    "heavy_on_top": f"""{_WITH}, {_LAYOUT}, h AS (SELECT shipment_id, container_no, box_id, x, y, box_id % 4 * 900 AS z, dx, dy, CASE WHEN dx % 5 = 0 THEN 850 ELSE 900 END AS dz, weight_kg AS kg FROM layout),
      e AS (SELECT a.shipment_id, a.container_no, a.box_id, a.kg FROM h a JOIN h b ON a.shipment_id = b.shipment_id AND a.container_no = b.container_no AND a.z > 0 AND b.z + b.dz = a.z AND a.x < b.x + b.dx AND b.x < a.x + a.dx AND a.y < b.y + b.dy AND b.y < a.y + a.dy
        GROUP BY 1, 2, 3, 4 HAVING a.kg > avg(b.kg) * 1.25), s AS (SELECT shipment_id, container_no, sum(kg) AS heavy FROM e GROUP BY 1, 2), t AS (SELECT shipment_id, container_no, sum(kg) AS total FROM h GROUP BY 1, 2)
      SELECT shipment_id, container_no, CAST(total AS BIGINT) AS total_kg, CAST(coalesce(heavy, 0) AS BIGINT) AS heavy_kg, round(coalesce(heavy, 0)::DOUBLE / total::DOUBLE, 6) AS ratio FROM t LEFT JOIN s USING (shipment_id, container_no)""",
    "layout_overlaps": f"""{_WITH}, {_LAYOUT} SELECT a.shipment_id, a.container_no, a.box_id AS box_a, b.box_id AS box_b FROM layout a JOIN layout b ON a.shipment_id = b.shipment_id AND a.container_no = b.container_no AND a.box_id < b.box_id
      AND a.x < b.x + b.dx AND b.x < a.x + a.dx AND a.y < b.y + b.dy AND b.y < a.y + a.dy AND a.z < b.z + b.dz AND b.z < a.z + a.dz""",
    "vgm_draft": f"""{_WITH}, {_ESTIMATE}, s AS (SELECT shipment_id, sum(weight_kg * qty)::DOUBLE AS cargo FROM cargo GROUP BY 1), j AS (SELECT shipment_id, cargo, greatest(greatest(bw, bv), 1) AS n FROM s JOIN est USING (shipment_id))
      SELECT shipment_id, CAST(unnest(generate_series(1, n)) AS INTEGER) AS container_no, round(cargo / n, 6) AS cargo_kg, round(cargo / n * 0.02::DOUBLE, 6) AS packaging_kg, 80.0::DOUBLE AS dunnage_kg, 3900.0::DOUBLE AS tare_kg, round(cargo / n * 1.02::DOUBLE + 80 + 3900, 6) AS vgm_kg FROM j""",
    "consolidate_greedy": f"""WITH RECURSIVE {SQL_CARGO}, f AS (SELECT shipment_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS placed FROM (SELECT DISTINCT shipment_id FROM cargo)
        UNION ALL SELECT f.shipment_id, k + 1, CASE WHEN used + length_mm <= 12032 THEN used + length_mm ELSE used END, CASE WHEN used + length_mm <= 12032 THEN placed + 1 ELSE placed END FROM f JOIN cargo c ON c.shipment_id = f.shipment_id AND c.row_id = f.k + 1)
      SELECT shipment_id, k AS n_items, placed, used AS used_mm FROM f QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY k DESC) = 1""",
    "manifest_by_part": f"""{_WITH} SELECT part_no, CAST(sum(qty) AS BIGINT) AS pieces, CAST(sum(qty * weight_kg) AS BIGINT) AS net_kg, count(DISTINCT shipment_id) AS n_shipments, array_to_string(list_sort(list(DISTINCT supplier_id)), ',') AS suppliers FROM cargo GROUP BY 1""",
    "manifest_by_container": f"{_WITH}, {_LAYOUT} SELECT shipment_id, container_no, count(*) AS n_boxes, CAST(sum(weight_kg) AS BIGINT) AS weight_kg, max(z) AS top_z FROM layout GROUP BY 1, 2",
    "split_by_net_cap": f"""{_WITH}, p AS (SELECT shipment_id, row_id, weight_kg, CAST(ceil(weight_kg::DOUBLE / 1000) AS INTEGER) AS parts FROM cargo WHERE weight_kg > 1000), e AS (SELECT *, CAST(unnest(generate_series(1, parts)) AS INTEGER) AS part FROM p)
      SELECT shipment_id, row_id, part, CASE WHEN part = parts THEN weight_kg - (weight_kg // parts) * (parts - 1) ELSE weight_kg // parts END AS part_kg FROM e""",
}
