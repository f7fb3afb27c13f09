"""Balance of loaded containers: a score of the mass centre, rigid moves in closed form, and a bounded search that keeps a step only if it scores better."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stowage import ORDERS, Policy, _Hold, by_rows, measures, stow

# The share of the mass wanted in the middle half, the shares below which it is poor or bad, the eccentricity across and the height that are still right, and what each costs.
MID_OK, MID_POOR, MID_BAD, ACROSS_OK, HEIGHT_OK = 0.60, 0.50, 0.40, 0.05, 0.55
MID_COST, POOR_COST, BAD_COST, ALONG_COST, ACROSS_COST, HEIGHT_COST = 20.0, 5.0, 15.0, 4.0, 8.0, 3.0
_WORSE = 1e-9


def score(mid: Column, along: Column, across: Column, height: Column) -> Column:
    """0 for a container in balance: mid is the share of its mass in the middle half, along and height are positions of the centre from 0 to 1, across its eccentricity."""
    poor = F.when(mid < MID_BAD, BAD_COST).when(mid < MID_POOR, POOR_COST).otherwise(0.0)
    over = lambda x, most: F.greatest(x - most, F.lit(0.0))
    return F.greatest(F.lit(MID_OK) - mid, F.lit(0.0)) * MID_COST + poor + F.abs(along - 0.5) * ALONG_COST + over(across, ACROSS_OK) * ACROSS_COST + over(height, HEIGHT_OK) * HEIGHT_COST


def balance(layout: DataFrame, size: tuple[int, int, int], *keys: str) -> DataFrame:
    """(keys, mid, along, across, height, score) of each container of layout(keys, x, y, z, dx, dy, dz, kg).

    Moments are sums of whole numbers (doubled millimetres by kilograms), so the order of rows plays no part. A container without mass has no row.
    """
    length, width, high = size
    moment = lambda a: F.sum((2 * F.col(a) + F.col(f"d{a}")).cast("bigint") * F.col("kg"))
    twice = 2 * F.col("x") + F.col("dx")
    middle = (2 * twice >= length) & (2 * twice <= 3 * length)
    sums = layout.groupBy(*keys).agg(F.sum("kg").alias("m"), F.sum(F.when(middle, F.col("kg")).otherwise(0)).alias("mid"), *(moment(a).alias(f"m{a}") for a in "xyz")).where("m > 0")
    mid, along, height = F.col("mid") / F.col("m"), F.col("mx") / F.col("m") / (2 * length), F.col("mz") / F.col("m") / (2 * high)
    across = F.abs(F.col("my") / F.col("m") / width - 1)
    return sums.select(*keys, mid.alias("mid"), along.alias("along"), across.alias("across"), height.alias("height")).withColumn("score", score(F.col("mid"), F.col("along"), F.col("across"), F.col("height")))


MOVES = ("stay", "shift", "turn", "mirror", "shift_mirror")


def rigid(layout: DataFrame, size: tuple[int, int, int], *keys: str) -> DataFrame:
    """layout with each container's load moved as a whole: towards the middle as far as it stays inside, turned end for end, mirrored across, or left.

    The move with the lowest score is taken, the earliest of equals in MOVES; column move names it. What stands on what does not change. Each move is
    a row of sums a container; only those meet the pieces again.
    """
    length, width, _ = size
    sums = layout.groupBy(*keys).agg(
        F.sum("kg").alias("m"), *(F.sum((2 * F.col(a) + F.col(f"d{a}")).cast("bigint") * F.col("kg")).alias(f"m{a}") for a in "xy"),
        *(F.min(a).alias(f"lo{a}") for a in "xy"), *(F.max(F.col(a) + F.col(f"d{a}")).alias(f"hi{a}") for a in "xy"),
    )
    # Floors of whole quotients: no step depends on how a double is rounded.
    wish = lambda a, most: F.when(F.col("m") > 0, F.floor((most * F.col("m") - F.col(f"m{a}")) / (2 * F.col("m")))).otherwise(0)
    by = lambda a, most: F.greatest(-F.col(f"lo{a}"), F.least(most - F.col(f"hi{a}"), wish(a, most))).cast("int")
    steps = sums.select(*keys, by("x", length).alias("sx"), by("y", width).alias("sy"))
    moves = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).alias("move")) for i, m in enumerate(MOVES)))
    each = layout.join(steps, list(keys)).withColumn("q", F.explode(moves)).select("*", "q.*").drop("q")
    shifts, mirrors = F.col("move").isin("shift", "shift_mirror"), F.col("move").isin("mirror", "shift_mirror")
    x = F.when(shifts, F.col("x") + F.col("sx")).when(F.col("move") == "turn", length - F.col("x") - F.col("dx")).otherwise(F.col("x"))
    y = F.when(shifts, F.col("y") + F.col("sy")).otherwise(F.col("y"))
    moved = each.withColumns({"x": x, "y": F.when(mirrors, width - y - F.col("dy")).otherwise(y)})
    scored = balance(moved, size, *keys, "i", "move")
    # Scores a hair apart are equal, so that the earlier move wins.
    best = scored.groupBy(*keys).agg(F.min(F.struct(F.round("score", 9).alias("s"), "i")).alias("b")).select(*keys, F.col("b.i").alias("_i"))
    chosen = moved.join(best, list(keys), "left").where(F.col("i") == F.coalesce("_i", F.lit(0)))
    return chosen.select(*layout.columns, "move")


Spots = list[tuple[int, int, int]]


def _score(at: Spots, ext: Spots, kg: list[float], size: tuple[int, int, int]) -> float:
    total = sum(kg)
    if total <= 0:
        return 0.0
    gx = gy = gz = mid = 0.0
    for (x, y, z), (dx, dy, dz), m in zip(at, ext, kg, strict=True):
        cx = x + dx / 2
        gx, gy, gz = gx + cx * m, gy + (y + dy / 2) * m, gz + (z + dz / 2) * m
        if size[0] / 4 <= cx <= size[0] * 3 / 4:
            mid += m
    gx, gy, gz, mid = gx / total, gy / total, gz / total, mid / total
    pen = max(0.0, MID_OK - mid) * MID_COST + (BAD_COST if mid < MID_BAD else POOR_COST if mid < MID_POOR else 0.0)
    return pen + abs(gx / size[0] - 0.5) * ALONG_COST + max(0.0, abs(gy / size[1] * 2 - 1) - ACROSS_OK) * ACROSS_COST + max(0.0, gz / size[2] - HEIGHT_OK) * HEIGHT_COST


def _sound(at: Spots, ext: Spots, kg: list[float], open_: list[bool], size: tuple[int, int, int], policy: Policy) -> list[int] | None:
    """The layers if every piece may stand so, else None: what bears what is worked out again from the floor up."""
    hold, layers = _Hold(size, float("inf"), policy), [0] * len(at)
    for k in sorted(range(len(at)), key=lambda k: (at[k][2], at[k][0])):
        found = hold.bears(at[k], ext[k], kg[k]) if open_[k] or at[k][2] == 0 else None
        if not found:
            return None
        layers[k] = found[0]
        hold.add(at[k], ext[k], kg[k], found, open_[k])
    return layers


def _slabs(at: Spots, ext: Spots, gap: int = 0) -> list[list[int]]:
    """Pieces that no plane across the container parts, or none with that much room."""
    slabs, end = [], None
    for k in sorted(range(len(at)), key=lambda k: at[k][0]):
        if end is None or at[k][0] >= end + gap:
            slabs.append([])
        slabs[-1].append(k)
        end = max(end or 0, at[k][0] + ext[k][0])
    return slabs


def _reorder(at: Spots, ext: Spots, kg: list[float], size: tuple[int, int, int], gap: int) -> Spots:
    """Slabs one behind the other, the heaviest a metre in the middle, the load centred between the doors."""
    slabs = _slabs(at, ext)
    starts = [min(at[k][0] for k in s) for s in slabs]
    length = [max(at[k][0] + ext[k][0] for k in s) - first for s, first in zip(slabs, starts, strict=True)]
    dense = [sum(kg[k] for k in s) / max(n, 1) for s, n in zip(slabs, length, strict=True)]
    row: list[int] = []
    for n, k in enumerate(sorted(range(len(slabs)), key=lambda k: -dense[k])):
        row = [*row, k] if n % 2 else [k, *row]
    out, x = list(at), max(0, (size[0] - sum(length) - gap * (len(slabs) - 1)) // 2)
    for k in row:
        for i in slabs[k]:
            out[i] = (at[i][0] + x - starts[k], *at[i][1:])
        x += length[k] + gap
    return out


def _flips(at: Spots, ext: Spots, size: tuple[int, int, int], gap: int) -> Iterator[Spots]:
    """Each slab mirrored across. Slabs keep the gap between them: pieces that were apart across only may meet when one is mirrored."""
    for s in _slabs(at, ext, gap):
        out = list(at)
        for k in s:
            out[k] = (at[k][0], size[1] - at[k][1] - ext[k][1], at[k][2])
        yield out


def _swaps(at: Spots, ext: Spots, kg: list[float]) -> Iterator[Spots]:
    """Two pieces of one size and different weight change places, the heaviest first. Pieces of a size are compared with their lightest and heaviest only where there are many."""
    kinds: dict[tuple, list[int]] = {}
    for k, e in enumerate(ext):
        kinds.setdefault(e, []).append(k)
    for _, same in sorted(kinds.items()):
        same.sort(key=lambda k: -kg[k])
        for i in range(min(len(same), 12)):
            for j in range(len(same) - 1, max(i, len(same) - 13), -1):
                if kg[same[i]] > kg[same[j]]:
                    out = list(at)
                    out[same[i]], out[same[j]] = at[same[j]], at[same[i]]
                    yield out


def repair(layout: DataFrame, size: tuple[int, int, int], payload: float, *keys: str, policy: Policy = Policy(), rounds: int = 4) -> DataFrame:  # noqa: B008
    """layout(keys, box_id, x, y, z, dx, dy, dz, layer, kg, stackable, tips) with each container's load in better balance, and columns before and after, its scores.

    Steps: slabs in another order, slabs mirrored across, pieces of one size changed over, and the whole load stowed again in other orders where it still
    fits one container. A step stays only if it scores better and every piece may stand so; rounds bound the steps. after is never above before. A container
    is held by one task; it holds what fits it.
    """
    kinds = dict(layout.dtypes)
    columns = [*keys, "box_id", "x", "y", "z", "dx", "dy", "dz", "layer", "kg", "stackable", "tips"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", before double, after double"

    def run(load: dict[str, list]) -> list[tuple]:
        at, ext = (list(zip(*(map(int, load[c]) for c in names), strict=True)) for names in (("x", "y", "z"), ("dx", "dy", "dz")))
        kg, open_, layers = [float(m or 0) for m in load["kg"]], [bool(o) for o in load["stackable"]], load["layer"]
        before = best = _score(at, ext, kg, size)

        def attempt(new: Spots) -> bool:
            nonlocal at, best, layers
            now = _score(new, ext, kg, size)
            if now >= best - _WORSE or any(a < 0 or a + e > most for spot, sides in zip(new, ext, strict=True) for a, e, most in zip(spot, sides, size, strict=True)):
                return False
            sound = _sound(new, ext, kg, open_, size, policy)
            if sound is None:
                return False
            at, best, layers = new, now, sound
            return True

        for _ in range(rounds):
            moved = best > _WORSE and attempt(_reorder(at, ext, kg, size, policy.clearance))
            for new in _flips(at, ext, size, policy.clearance) if best > _WORSE else ():
                moved |= attempt(new)
            for new in _swaps(at, ext, kg) if best > _WORSE else ():
                if attempt(new):
                    moved = True
                    break
            if not moved:
                break
        if best > MID_COST * (1 - MID_OK) / 2:  # still poor: stow it anew
            pieces = [{"k": k, "l": l, "w": w, "h": h, "stackable": open_[k], "tips": False, **measures(l, w, h, kg[k])} for k, (l, w, h) in enumerate(ext)]
            for by in ORDERS.values():
                ranked = sorted(pieces, key=lambda p, by=by: (p["stackable"], *(-p[m] for m in by)))
                spots = stow(ranked, size, payload, policy)
                if all(spot[0] == 1 for spot in spots):
                    step = (size[0] - max(spot[1] + spot[4] for spot in spots)) // 2
                    new_at, new_ext = list(at), list(ext)
                    for p, (_, x, y, z, dx, dy, dz, _) in zip(ranked, spots, strict=True):
                        new_at[p["k"]], new_ext[p["k"]] = (x + step, y, z), (dx, dy, dz)
                    if (now := _score(new_at, new_ext, kg, size)) < best - _WORSE and (sound := _sound(new_at, new_ext, kg, open_, size, policy)) is not None:
                        at, ext, best, layers = new_at, new_ext, now, sound
        new = {**load, **dict(zip(("x", "y", "z"), zip(*at, strict=True), strict=True)), **dict(zip(("dx", "dy", "dz"), zip(*ext, strict=True), strict=True)), "layer": layers}
        return [(*row, before, best) for row in zip(*(new[c] for c in columns), strict=True)]

    return by_rows(layout.where("container_no > 0").select(*columns), list(keys), [F.col("box_id")], run, schema)


def container_search(layout: DataFrame, pieces: DataFrame, size: tuple[int, int, int], payload: float, fill: float, most: int, key: str) -> DataFrame:
    """(key, n0, n, left_out, fits): how many containers a stowage took against the fewest that weight and volume allow, at most `most`.

    n0 is what a search would begin with; the stowage opens one more whenever a piece finds no place, so n is the first number that it fits.
    """
    room = float(size[0]) * size[1] * size[2] * fill
    bound = pieces.groupBy(key).agg(F.sum(F.coalesce("kg", F.lit(0))).alias("kg"), F.sum(F.col("l").cast("bigint") * F.col("w") * F.col("h")).alias("mm3"))
    n0 = F.greatest(F.ceil(F.col("kg") / payload - 1e-9), F.ceil(F.col("mm3") / room - 1e-9), F.lit(1)).cast("bigint")
    used = layout.groupBy(key).agg(F.count_distinct(F.when(F.col("container_no") > 0, F.col("container_no"))).alias("n"), F.count_if(F.col("container_no") == 0).alias("left_out"))
    return bound.select(key, n0.alias("n0")).join(used, key).select(key, "n0", "n", "left_out", ((F.col("left_out") == 0) & (F.col("n") <= most)).alias("fits"))
