"""Typed readings of dirty cells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
# Kilograms of a unit of weight, millimetres of a unit of length.
WEIGHT_UNITS = {"kg": 1.0, "g": 0.001, "t": 1000.0, "lb": 0.45359237}
LENGTH_UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4}


def plain_double(cell: Column) -> Column:
    """A cell that is a decimal number and nothing else, as a double, else null: 12, -3.5 and 1e3 are, 5d, 0x1f, inf and NaN are not."""
    text = F.trim(cell)
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


def number(cell: Column) -> Column:
    """What is left of a cell without letters and signs, as a double; null if that is no number."""
    return plain_double(F.regexp_replace(cell, r"[^0-9.\-eE]", ""))


def quantity(cell: Column) -> Column:
    """struct(state, qty): ok for a whole number above 0, else missing, zero or invalid."""
    text = F.regexp_replace(F.trim(cell), r"(?i)\s*(pcs?|ea|sets?)\.?$", "")
    value = plain_double(text)
    state = F.when(cell.isNull() | (F.trim(cell) == ""), "missing").when(value.isNull() | F.isnan(value) | (value < 0) | (value != F.floor(value)), "invalid").when(value == 0, "zero").otherwise("ok")
    return F.struct(state.alias("state"), F.when(state == "ok", value.try_cast("bigint")).alias("qty"))


def dimensions(cell: Column) -> Column:
    """struct(l, w, h) of a cell like 1,200 x 800 x 600; nulls if it has not three numbers."""
    pattern = rf"(?i)^\s*({_NUMBER})\s*[x*×]\s*({_NUMBER})\s*[x*×]\s*({_NUMBER})"
    part = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(cell, pattern, k), ",", ""), F.lit("")).try_cast("double")
    return F.struct(part(1).alias("l"), part(2).alias("w"), part(3).alias("h"))


def weight_kg(cell: Column, scale: float = 1.0) -> Column:
    """A weight in kilograms by its own unit, or times scale if it states none; null for ranges, forces and what is no weight."""
    pattern = rf"(?i)^\s*({_NUMBER})\s*(kgs?|g|t|tons?|lbs?)?\.?\s*$"
    value = F.nullif(F.regexp_replace(F.regexp_extract(cell, pattern, 1), ",", ""), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(cell, pattern, 2))
    own = F.when(unit.isin("t", "ton", "tons"), WEIGHT_UNITS["t"]).when(unit == "g", WEIGHT_UNITS["g"]).when(unit.isin("lb", "lbs"), WEIGHT_UNITS["lb"])
    return value * own.when(unit == "", scale).otherwise(1.0)


def hollow_section(b: Column, h: Column, t: Column) -> Column:
    """struct(area, inertia, modulus, radius) of a hollow rectangular section: the stiffer axis for bending, the smaller radius, which
    is the safe side for columns. Nulls if the wall leaves no hollow."""
    inner_b, inner_h = b - 2 * t, h - 2 * t
    area = b * h - inner_b * inner_h
    by_h = (b * h * h * h - inner_b * inner_h * inner_h * inner_h) / 12
    by_b = (h * b * b * b - inner_h * inner_b * inner_b * inner_b) / 12
    sound = (t > 0) & (inner_b > 0) & (inner_h > 0)
    modulus = F.when(by_h >= by_b, 2 * by_h / h).otherwise(2 * by_b / b)
    values = {"area": area, "inertia": F.greatest(by_h, by_b), "modulus": modulus, "radius": F.sqrt(F.least(by_h, by_b) / area)}
    return F.struct(*(F.when(sound, v).alias(k) for k, v in values.items()))


def solid_section(b: Column, h: Column) -> Column:
    """struct(area, inertia, modulus, radius) of a solid rectangular section about its height."""
    inertia = b * h * h * h / 12
    return F.struct((b * h).alias("area"), inertia.alias("inertia"), (2 * inertia / h).alias("modulus"), F.sqrt(inertia / (b * h)).alias("radius"))


def section(name: Column) -> Column:
    """struct(kind, b, h, t) of a section's name in mm: 40x40x3 with or without 方管, 矩形管, RHS or SHS; 木梁100x120. Nulls if it is neither."""
    bare = F.regexp_replace(F.regexp_replace(name, "[×*X]", "x"), r"\s+", "")
    tube, wood = r"(?i)^(?:方管|矩形管|RHS|SHS)?([0-9]+(?:\.[0-9]+)?)x([0-9]+(?:\.[0-9]+)?)x([0-9]+(?:\.[0-9]+)?)$", r"^木梁([0-9]+)x([0-9]+)$"
    size = lambda pattern, k: F.nullif(F.regexp_extract(bare, pattern, k), F.lit("")).try_cast("double")
    b, h = F.coalesce(size(tube, 1), size(wood, 1)), F.coalesce(size(tube, 2), size(wood, 2))
    kind = F.when(size(tube, 3).isNotNull(), F.when(b == h, "square_tube").otherwise("rect_tube")).when(b.isNotNull(), "wood_rect")
    return F.struct(kind.alias("kind"), b.alias("b"), h.alias("h"), size(tube, 3).alias("t"))
