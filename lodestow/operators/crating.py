"""Crates for cargo rows: rows cut by net weight and by what can be piled, a type for each, and rows put together greedily, longest first."""

from __future__ import annotations

from collections.abc import Iterable
from copy import copy
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stowage import by_rows, count_lots, lot_of

# Crates by name; outer length, width and height and wall in mm, tare and payload in kg, in the order of preference.
CRATES = [
    ("1.1m frame", 1100, 1100, 1500, 40, 90, 1200),
    ("cage", 2000, 1100, 1500, 30, 100, 2000),
    ("2m frame", 2000, 1100, 1750, 50, 120, 2500),
    ("3m case", 3000, 1100, 1200, 40, 60, 1500),
    ("4m frame", 4000, 1100, 1750, 50, 180, 3500),
    ("6m frame", 6000, 1100, 1550, 50, 251, 4000),
]
CRATE_COLUMNS = ["crate_type", "outer_l", "outer_w", "outer_h", "wall", "tare_kg", "payload_kg"]
# Up to which length of content which crates are tried, in order; how much longer than standard a crate may be made; the room around a piece.
TIERS = [(1050, ("1.1m frame", "cage", "2m frame")), (1950, ("2m frame", "cage", "3m case")), (2900, ("4m frame", "3m case", "2m frame", "cage")), (4500, ("4m frame", "6m frame")), (None, ("6m frame", "4m frame"))]
LONGER, LONGER_MM, CLEARANCE_MM = 1.2, 800, 50
# From which length in mm which net weight of a crate is allowed; bands of length with their rank.
CAPS = [(5000, 480.0), (3500, 560.0), (2500, 400.0), (1500, 700.0)]
BANDS = [(5000, "6m", 5), (3500, "4m", 4), (2500, "3m", 3), (1500, "2m", 2)]
NET_CAP, FILL = 3200.0, 0.98
# Fixed values in mm and kg: piles of flat pieces and of bars.
PILE_MM, SHORT_PILE_MM, FLAT_MM, FACE_MM, WIDE_MM, GLASS_MM, LONG_MM, VERY_LONG_MM = 1100, 2000, 80, 400, 1000, 1100, 3500, 5000


def _by_length(length: Column, steps: Iterable[tuple], otherwise: object, at: int = 1) -> Column:
    out = None
    for step in steps:
        out = F.when(length >= step[0], step[at]) if out is None else out.when(length >= step[0], step[at])
    return out.otherwise(otherwise)


def net_cap(length: Column, cap: float = NET_CAP) -> Column:
    """The net weight that a crate of such pieces may hold: less for long ones, which bend."""
    return F.least(F.lit(cap), _by_length(length, CAPS, cap))


def length_band(length: Column) -> Column:
    return _by_length(length, BANDS, "1m")


def most_pieces(length: Column, width: Column, height: Column, unit_kg: Column, qty: Column, cap: Column) -> Column:
    """How many pieces of a row one crate may hold: by weight, and by how high flat pieces are piled or how many bars lie side by side; 1 at least."""
    thin, face = F.when((width > 0) & (height > 0), F.least(width, height)).otherwise(F.greatest(height, F.lit(1))), F.greatest(width, height)
    flat = (face >= FACE_MM) & (thin <= FLAT_MM)
    times = lambda total, each: F.greatest(F.lit(1), F.floor(total / F.greatest(each, F.lit(1)))).cast("int")
    piled = times(F.when(length <= 2200, SHORT_PILE_MM).otherwise(PILE_MM), thin)
    piled = F.when(face >= WIDE_MM, F.least(piled, times(F.lit(1200), thin))).otherwise(piled)
    piled = F.when(face >= GLASS_MM, F.least(piled, F.lit(12))).otherwise(piled)
    across = F.greatest(F.least(width, height), F.lit(20))
    bars = F.greatest(F.lit(1), F.floor(times(F.lit(1000), across) * times(F.lit(PILE_MM), across) / 2)).cast("int")
    others = times(F.lit(PILE_MM), F.greatest(F.least(width, height), F.lit(50))) * 4
    room = F.when(flat, piled).when(length >= LONG_MM, bars).otherwise(others)
    limit = F.when(flat, F.least(cap, F.lit(1500.0))).when(length >= LONG_MM, F.least(cap, F.when(length >= VERY_LONG_MM, 280.0).otherwise(900.0))).otherwise(cap)
    weigh = F.when(unit_kg > 0, F.greatest(F.lit(1), F.floor(limit / unit_kg)).cast("int")).otherwise(qty)
    return F.greatest(F.lit(1), F.least(qty, weigh, room)).cast("int")


def split_rows(rows: DataFrame, *keys: str, cap: float = NET_CAP) -> DataFrame:
    """(keys, part, l, w, h, pieces, net_kg): rows(keys, l, w, h, qty, total_kg) cut so that no part is over its crate's net weight.

    A piece over the cap is cut into equal parts by weight, rounded to grams, the last taking the rest; other rows are cut into parts of as many
    pieces as a crate may hold. No quantity is one piece. pieces is null in a part of a piece.
    """
    kinds = part_kinds(rows, *keys, cap=cap)
    return kinds.select(*keys, F.explode("parts").alias("part"), "l", "w", "h", "pieces", "net_kg")


def part_kinds(rows: DataFrame, *keys: str, cap: float = NET_CAP) -> DataFrame:
    """(keys, l, w, h, pieces, net_kg, times, parts): the parts of ``split_rows``, equal ones of a row together, two kinds a row at most; parts are their numbers."""
    qty = F.greatest(F.coalesce("qty", F.lit(1)), F.lit(1)).cast("int")
    each = rows.select(*keys, "l", "w", "h", qty.alias("qty"), F.coalesce("total_kg", F.lit(0.0)).cast("double").alias("total"), net_cap(F.col("l"), cap).alias("cap")).withColumn("unit", F.col("total") / F.col("qty"))
    over = F.col("unit") > F.col("cap") + 1e-6
    n = F.greatest(F.lit(2), F.ceil(F.col("unit") / F.col("cap") - 1e-9)).cast("int")
    most = most_pieces(F.col("l"), F.col("w"), F.col("h"), F.col("unit"), F.col("qty"), F.col("cap"))
    most = F.when((most >= F.col("qty")) & (F.col("total") > F.col("cap") + 1e-6), F.greatest(F.lit(1), F.floor(F.col("qty") / 2))).otherwise(most).cast("int")
    # A heavy piece is n parts, the last of them with the rest; other rows are n crates' parts, the last of them with the rest.
    each = each.withColumns({"over": over, "most": F.when(~over, most)}).withColumn("n", F.when(F.col("over"), n).otherwise(F.ceil(F.col("qty") / F.col("most")).cast("int")))
    share, last, rounds = F.round(F.col("unit") / F.col("n"), 3), F.col("qty") - (F.col("n") - 1) * F.col("most"), F.col("n") - 1
    least, none = F.round(F.col("unit") - share * rounds, 3), F.lit(None)
    # rest: is this the last part, or one before it? Null where they are equal, and one kind.
    kind = lambda rest, times, pieces, net: F.struct(rest.alias("rest"), times.cast("int").alias("times"), pieces.cast("int").alias("pieces"), net.alias("net_kg"))
    kinds = lambda same, each, first, second: F.array(kind(F.when(~same, F.lit(False)), F.when(same, F.col("n")).otherwise(rounds) * each, *first), kind(F.lit(True), F.when(same, 0).otherwise(1) * each, *second))
    heavy = kinds(share == least, F.col("qty"), (none, share), (none, least))
    light = kinds(last == F.col("most"), F.lit(1), (F.col("most"), F.round(F.col("unit") * F.col("most"), 3)), (last, F.round(F.col("unit") * last, 3)))
    found = each.withColumn("k", F.explode(F.when(F.col("over"), heavy).otherwise(light))).where("k.times > 0").select("*", "k.*")
    every = F.sequence(F.lit(1), F.col("n") * F.when(F.col("over"), F.col("qty")).otherwise(1))
    parts = F.filter(every, lambda k: F.coalesce((k % F.col("n") == 0) == F.col("rest"), F.lit(True)))
    return found.select(*keys, "l", "w", "h", "pieces", "net_kg", "times", parts.alias("parts"))


def crate_type(length: Column, width: Column, height: Column, net_kg: Column) -> Column:
    """Of the types for that length the first that takes the size and the weight, else the first that takes the size, else the longest.

    A type takes pieces up to a fifth or 800 mm longer than it is, as it is made so much longer; either side may be upright.
    """
    spec = {row[0]: row for row in CRATES}

    def fits(name: str) -> Column:
        _, l, w, h, wall, _, _ = spec[name]  # noqa: E741
        along = length + CLEARANCE_MM
        long = (along <= l - 2 * wall) | (along + 2 * wall <= max(l * LONGER, l + LONGER_MM))
        a, b = width + CLEARANCE_MM, height + CLEARANCE_MM
        return long & (((a <= w - 2 * wall) & (b <= h - 2 * wall)) | ((a <= h - 2 * wall) & (b <= w - 2 * wall)))

    out = F.lit(None).cast("string")
    for most, names in reversed(TIERS):
        first = lambda ok, names=names: F.coalesce(*(F.when(ok(n), F.lit(n)) for n in names))
        pick = F.coalesce(first(lambda n: fits(n) & (net_kg <= spec[n][6] + 1e-6)), first(fits), F.lit(CRATES[-1][0]))
        out = pick if most is None else F.when(length <= most, pick).otherwise(out)
    return out


def _rank(length: float) -> int:
    return next((rank for least, _, rank in BANDS if length >= least), 1)


class _Crates:
    """Some equal crates: their type, what each holds, the outer length that this needs, and the room that this length gives.

    holds has (run, start, m): the first crate holds the parts start to start + m of that run, the second the next m.
    """

    __slots__ = ("name", "l", "w", "h", "wall", "tare", "payload", "most", "limit", "holds", "net", "mm3", "longest", "room", "count", "cap", "fits")

    def __init__(self, name: str, cap: float, count: int = 1) -> None:
        _, self.l, self.w, self.h, self.wall, self.tare, self.payload = _SPEC[name]
        self.name, self.count, self.most, self.limit = name, count, max(self.l * LONGER, self.l + LONGER_MM), min(cap, self.payload)
        self.holds, self.net, self.mm3, self.longest, self.room, self.cap, self.fits = [], 0.0, 0.0, 0.0, 0.0, cap, None

    @property
    def outer(self) -> float:
        return max(self.l, self.longest + CLEARANCE_MM + 2 * self.wall)

    def held(self, longest: float) -> float:
        """What a crate for pieces of this length holds in cubic millimetres; nothing if it may not be made so long."""
        length = longest + CLEARANCE_MM + 2 * self.wall
        return -1.0 if length > self.most else (max(self.l, length) - 2 * self.wall) * (self.w - 2 * self.wall) * (self.h - 2 * self.wall) * FILL

    def add(self, no: int, start: int, m: int, run: _Run) -> None:
        """m parts of a run into each. The lowest cap of what it holds is its own."""
        self.holds.append((no, start, m))
        self.limit, self.cap, self.fits = min(self.limit, run.cap), min(self.cap, run.cap), run.fits if self.fits is None else self.fits & run.fits
        for _ in range(m):
            self.net, self.mm3 = self.net + run.net, self.mm3 + run.mm3
        if run.l > self.longest:
            self.longest, self.room = run.l, self.held(run.l)

    def takes(self, run: _Run, most: int) -> int:
        """How many parts of a run, at most so many, one of these crates takes on top of what it holds; no part is longer than what it holds."""
        net, mm3, limit, m = self.net, self.mm3, self.limit + 1e-6, 0
        most = most if self.name in run.fits else 0
        while m < most and net + run.net <= run.cap + 1e-6 and net + run.net <= limit and mm3 + run.mm3 <= self.room:
            net, mm3, limit, m = net + run.net, mm3 + run.mm3, min(limit, run.cap + 1e-6), m + 1
        return m

    def part(self, first: int, count: int) -> _Crates:
        """Some of these crates, from the first so many on."""
        other = copy(self)
        other.holds, other.count = [(no, start + first * m, m) for no, start, m in self.holds], count
        return other


class _Run:
    """Equal parts of one row, times of them, and the types that they go into."""

    __slots__ = ("l", "net", "mm3", "cap", "name", "times", "fits")

    def __init__(self, l: float, w: float, h: float, n: int, net: float, cap: float, name: str, times: int, fits: frozenset[str]) -> None:  # noqa: E741
        self.l, self.net, self.mm3, self.cap, self.name, self.times, self.fits = l, net, float(l) * w * h * n, cap, name, times, fits


_SPEC = {row[0]: row for row in CRATES}
_INNER = {name: (w - 2 * wall, h - 2 * wall) for name, _, w, h, wall, _, _ in CRATES}


def _types(w: float, h: float) -> frozenset[str]:
    """The types that a piece of these sides goes into, either side upright."""
    a, b = w + CLEARANCE_MM, h + CLEARANCE_MM
    return frozenset(n for n, (iw, ih) in _INNER.items() if (a <= iw and b <= ih) or (a <= ih and b <= iw))


def fill_crates(runs: list[_Run]) -> list[_Crates]:
    """Parts, longest first, each into the fullest open crate that takes it, or one of its own; then the emptiest crates are dissolved into others while that works.

    Equal parts and equal crates are dealt with together: a crate takes as many of a run as it can, and so do all its equals.
    """
    crates: list[_Crates] = []
    least = list(accumulate((r.net for r in reversed(runs)), min))[::-1]  # the lightest part from here on
    open_: list[_Crates] = []
    for no, run in enumerate(runs):
        # No part is longer than one before it: a crate keeps its length, and none is too short for what comes.
        net, cap, mm3, fits, at, new = run.net, run.cap + 1e-6, run.mm3, run.fits, 0, []
        while at < run.times:
            some, fullest = None, -1.0
            for c in open_:
                held = c.net
                if held > fullest and held + net <= cap and held + net <= c.limit + 1e-6 and c.mm3 + mm3 <= c.room and c.name in fits:
                    some, fullest = c, held
            if some is None:
                break
            left = run.times - at
            m = some.takes(run, left)
            full = min(some.count, left // m)
            taken, rest = [some.part(0, full)], some.count - full
            taken[0].add(no, at, m, run)
            at += full * m
            if rest and at < run.times and run.times - at < m:
                taken.append(some.part(full, 1))
                taken[-1].add(no, at, run.times - at, run)
                at, rest = run.times, rest - 1
            others = [some.part(some.count - rest, rest)] if rest else []
            for held in (crates, open_):
                k = held.index(some)
                held[k : k + 1] = taken + others
            new += taken
        if at < run.times:
            first = _Crates(run.name, run.cap)
            first.add(no, at, 1, run)
            m = 1 + first.takes(run, run.times - at - 1)
            full, rest = divmod(run.times - at, m)
            for count, each in ((full, m), (1, rest)):
                if count and each:
                    more = _Crates(run.name, run.cap, count)
                    more.add(no, at, each, run)
                    at += count * each
                    new.append(more)
                    crates.append(more)
                    open_.append(more)
        for c in new:
            if (c.room < 0 or (no + 1 < len(runs) and c.net + least[no + 1] > c.limit + 1e-6)) and c in open_:
                open_.remove(c)  # too long to take anything, or nothing that comes is light enough for it
    return _dissolved(sorted(crates, key=lambda c: c.net), runs)


def _dissolved(crates: list[_Crates], runs: list[_Run]) -> list[_Crates]:
    i = 0
    while i < len(crates):
        guest = crates[i]
        cap, fits, rank = guest.cap, guest.fits, _rank(guest.longest)
        j = next_ = i if guest.count > 1 else i + 1
        for j in range(next_, len(crates)):
            host = crates[j]
            if guest.net + host.net > cap + 1e-6:
                host = None  # all others are heavier still
                break
            # Short ones go into crates for longer ones only.
            if not (guest.net + host.net > host.limit + 1e-6 or host.name not in fits or rank > _rank(host.longest) or host.mm3 + guest.mm3 > (host.room if guest.longest <= host.longest else host.held(guest.longest))):
                break
        else:
            host = None
        if host is None:
            i += 1  # nor do its equals find a host
            continue
        both = host.part(1 if host is guest else 0, 1)
        for no, start, m in guest.holds:
            both.add(no, start, m, runs[no])
        if host is guest:
            crates[i : i + 1] = [both, guest.part(2, guest.count - 2)] if guest.count > 2 else [both]
            j = i
        else:
            crates[j : j + 1] = [both, host.part(1, host.count - 1)] if host.count > 1 else [both]
            crates[i : i + 1] = [guest.part(1, guest.count - 1)] if guest.count > 1 else []
            j -= guest.count == 1
        while j + 1 < len(crates) and crates[j + 1].net < both.net:  # the host is heavier now
            crates[j], crates[j + 1], j = crates[j + 1], both, j + 1
    return crates


def equal_crates(rows: DataFrame, key: str, row: str, cap: float = NET_CAP) -> DataFrame:
    """(key, row, parts, each, pieces, net_kg, crate_no, crates, crate_type, crate_net_kg, gross_kg, outer_l, outer_w, outer_h): crates that hold the same, together.

    The first of ``crates`` crates from crate_no on holds the first ``each`` of parts, the next the next; pieces and net_kg are a part's, all else is a
    crate's. A row for each kind of part in each lot of equal crates: where orders are large this is a small share of the parts.
    """
    named = part_kinds(rows, key, row, cap=cap).withColumns({"cap": net_cap(F.col("l"), cap), "crate_type": crate_type(F.col("l"), F.col("w"), F.col("h"), F.col("net_kg")), "n": F.coalesce("pieces", F.lit(1))})
    text = lambda c: c.cast("string")
    # Parts in the order of their names. Those of a shipment of many parts are dealt over lots one by one.
    ordered = F.transform(F.array_sort(F.transform("parts", text)), lambda p: p.cast("int"))
    dealt = lambda p: F.struct(lot_of(F.concat_ws("-", text(F.col(row)), text(p))).alias("lot"), F.array(p).alias("parts"))
    lots = F.when(F.col("_lots") > 1, F.transform("parts", dealt)).otherwise(F.array(F.struct(F.lit(0).alias("lot"), ordered.alias("parts"))))
    parts = count_lots(named, key, F.col("times")).withColumn("_p", F.explode(lots)).select(key, row, "_p.lot", "_p.parts", "l", "w", "h", "n", "pieces", "net_kg", "cap", "crate_type", text(F.col(row)).alias("box"))
    kinds = dict(parts.dtypes)
    schema = f"{key} {kinds[key]}, {row} {kinds[row]}, parts array<int>, each int, pieces int, net_kg double, crate_no bigint, crates int, crate_type string, crate_net_kg double, gross_kg double, outer_l double, outer_w double, outer_h double"
    order = [F.desc("l"), F.desc("net_kg"), F.desc(F.col("l").cast("double") * F.col("w") * F.col("h")), F.col("box")]

    def run(lot: dict[str, list]) -> list[tuple]:
        runs, whose, fits = [], [], {}
        l, w, h, net, box, n, numbers = (lot[c] for c in ("l", "w", "h", "net_kg", "box", "n", "parts"))  # noqa: E741
        tie = [(a, k, float(a) * b * c) for a, k, b, c in zip(l, net, w, h, strict=True)]
        k = 0
        while k < len(l):
            end = k + 1
            while end < len(l) and tie[end] == tie[k]:
                end += 1
            # What sorts alike goes by name: parts of one row together, those of several one by one.
            if end == k + 1:
                same = [(k, numbers[k])]
            elif len({(box[i], w[i], h[i], n[i]) for i in range(k, end)}) == 1:
                same = [(k, sorted((p for i in range(k, end) for p in numbers[i]), key=str))]
            else:
                same = [(i, [p]) for _, i, p in sorted((f"{box[i]}-{p}", i, p) for i in range(k, end) for p in numbers[i])]
            for i, ps in same:
                sides = (w[i], h[i])
                if sides not in fits:
                    fits[sides] = _types(*sides)
                runs.append(_Run(l[i], w[i], h[i], n[i], net[i], lot["cap"][i], lot["crate_type"][i], len(ps), fits[sides]))
                whose.append((i, ps))
            k = end
        no, out = lot["lot"][0] * 1_000_000 + 1, []
        for c in fill_crates(runs):
            crate = (no, c.count, c.name, round(c.net, 3), round(c.net + c.tare * c.outer / c.l, 1), float(c.outer), float(c.w), float(c.h))
            for r, start, m in c.holds:
                i, ps = whose[r]
                out.append((lot[key][i], lot[row][i], ps[start : start + c.count * m], m, lot["pieces"][i], net[i], *crate))
            no += c.count
        return out

    return by_rows(parts, [key, "lot"], order, run, schema)


def build_crates(rows: DataFrame, key: str, row: str, cap: float = NET_CAP) -> DataFrame:
    """(key, row, part, pieces, net_kg, crate_no, crate_type, crate_net_kg, gross_kg, outer_l, outer_w, outer_h): every part of every row in one crate.

    rows(key, row, l, w, h, qty, total_kg). Crates hold what their net cap, payload, room and bands of length allow; a part that fits no type goes alone
    into the longest, made as long as it needs, and is for a person to look at. A shipment of many parts is built by lots, dealt by hash.
    """
    equal = equal_crates(rows, key, row, cap)
    each = equal.select("*", F.posexplode("parts").alias("_at", "part"))
    no = F.col("crate_no") + F.floor(F.col("_at") / F.col("each"))
    return each.select(key, row, "part", "pieces", "net_kg", no.alias("crate_no"), *(c for c in equal.columns if c.startswith(("crate_type", "crate_net", "gross", "outer"))))


def crate_faults(built: DataFrame, rows: DataFrame, key: str, row: str) -> DataFrame:
    """(key, kind, what): rows whose pieces or weight the crates don't hold in full, and crates over their payload or longer than their type may be made.

    built is of ``build_crates``, or of ``equal_crates``: there a row stands for each * crates parts, and equal crates are added up once and named one by one.
    """
    built = built if "each" in built.columns else built.withColumns({"each": F.lit(1), "crates": F.lit(1)})
    times = F.col("each") * F.col("crates")
    text = lambda c: F.col(c).cast("string")
    spec = built.sparkSession.createDataFrame(CRATES, CRATE_COLUMNS)
    held = built.groupBy(key, row).agg(F.sum(F.col("pieces") * times).alias("n"), F.sum(F.col("net_kg") * times).alias("kg"))
    met = rows.select(key, row, F.greatest(F.coalesce("qty", F.lit(1)), F.lit(1)).alias("qty"), F.coalesce("total_kg", F.lit(0.0)).alias("total_kg")).join(held, [key, row], "full")
    lost = F.col("kg").isNull() | F.col("total_kg").isNull() | (F.col("n") != F.col("qty")) | (F.abs(F.col("kg") - F.col("total_kg")) > 0.002 * F.col("qty"))
    found = met.where(lost).select(key, F.lit("not_conserved").alias("kind"), text(row).alias("what"))
    crates = built.groupBy(key, "crate_no", "crate_type").agg(F.sum(F.col("net_kg") * F.col("each")).alias("kg"), F.first("outer_l").alias("outer"), F.sum("each").alias("parts"), F.first("crates").alias("crates")).join(F.broadcast(spec), "crate_type")
    named = lambda rows, kind: rows.select(key, F.lit(kind), F.explode(F.sequence(F.col("crate_no"), F.col("crate_no") + F.col("crates") - 1).cast("array<string>")))
    found = found.union(named(crates.where((F.col("kg") > F.col("payload_kg") + 1e-6) & (F.col("parts") > 1)), "payload"))
    longest = F.greatest(F.col("outer_l") * LONGER, F.col("outer_l") + LONGER_MM)
    return found.union(named(crates.where((F.col("outer") > longest + 1e-6) & (F.col("parts") > 1)), "too_long"))
