"""Checks of crates: columns, bearing, lifting. Loads in kg, lengths in mm, sections in cm, forces in N, stresses in MPa."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gravity, bounds of slenderness, allowed stresses of steel and wood.
G = 9.80665
SLENDER = {"comfortable": 100.0, "caution": 120.0, "steel": 150.0, "wood": 120.0}
BENDING_MPA = {"steel": 205.0, "wood": 12.0}
BEARING_MPA = {"steel": 120.0, "wood": 8.0}
PAD_MM2 = 80.0 * 80.0


def column_stability(load: Column, height: Column, area_cm2: Column, radius_cm: Column, steel: Column, columns: int = 4, k: float = 1.0) -> Column:
    """struct(axial_n, slenderness, stress, allowed, band, status) of the columns that carry a load."""
    force = load * G / max(columns, 4)
    slender = F.when(radius_cm > 0, k * height / 10 / radius_cm).otherwise(999.0)
    most = F.when(steel, SLENDER["steel"]).otherwise(SLENDER["wood"])
    allowed = F.when(steel, BENDING_MPA["steel"]).otherwise(BENDING_MPA["wood"]) * 0.7
    stress = force / (area_cm2 * 100)
    status = F.when((slender > most) | (stress > allowed), "fail").when(slender > SLENDER["caution"], "reinforce").otherwise("pass")
    band = F.when(slender >= most, "over").when(slender > SLENDER["caution"], "caution").when(slender > SLENDER["comfortable"], "acceptable").otherwise("safe")
    values = {"axial_n": force, "slenderness": slender, "stress": stress, "allowed": allowed, "band": band, "status": status}
    return F.struct(*(v.alias(n) for n, v in values.items()))


def local_bearing(load: Column, heaviest: Column, area: Column, steel: Column) -> Column:
    """struct(force_n, stress, status): the heaviest piece with a fifth on top, or a quarter of the load if none is known, on its pad."""
    force = F.when(heaviest > 0, heaviest * G * 1.2).otherwise(load * G / 4)
    stress = force / F.when(area > 0, area).otherwise(PAD_MM2)
    allowed = F.when(steel, BEARING_MPA["steel"]).otherwise(BEARING_MPA["wood"])
    return F.struct(force.alias("force_n"), stress.alias("stress"), F.when(stress <= allowed, "pass").otherwise("fail").alias("status"))


def lifting_points(load: Column, count: Column, symmetric: Column, eccentricity: Column) -> Column:
    """struct(force_n, status): the force at each point; fewer than four points carry light loads only, and an eccentric hitch fails."""
    points = F.greatest(F.when(count == 0, 4).otherwise(count), F.lit(1))
    factor = F.when(symmetric, eccentricity).otherwise(F.greatest(eccentricity, F.lit(1.25)))
    enough = (points >= 4) | (load < 800)
    return F.struct((load * G / points * factor).alias("force_n"), F.when(enough & (factor <= 1.35), "pass").otherwise("fail").alias("status"))
