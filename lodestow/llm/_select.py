"""Exact order statistics by rounds of histograms: only counts of bounded tables reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12  # a round cuts each open interval into 4,096 cells


def splitters(keys: DataFrame, targets: list[int], tolerance: int, key_bits: int = 60) -> list[int]:
    """For each target (ascending) a key b such that the weight of keys < b differs from it by at most tolerance, or as little as one key allows.

    keys(key bigint in [0, 2**key_bits), weight bigint). Each round counts exact weights in the cells of the
    intervals still open (at most one per target) and keeps the cell that holds each target.
    """
    open_: dict[int, tuple[int, int]] = {k: (0, 0) for k in range(len(targets))}  # target -> (interval's prefix, weight below it)
    out: dict[int, int] = {}
    shift = key_bits
    while open_:
        step = min(BITS, shift)
        prefixes = sorted({p for p, _ in open_.values()})
        part = keys if shift == key_bits else keys.where(F.shiftright("key", shift).isin(prefixes))
        shift -= step
        cells: dict[int, list[tuple[int, int]]] = {}
        for row in part.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("weight").alias("w")).collect():  # 4,096 cells a target at most
            cells.setdefault(row.cell >> step, []).append((row.cell, row.w))
        for k, (prefix, below) in list(open_.items()):
            found = False
            for cell, weight in sorted(cells.get(prefix, [])):
                if below + weight > targets[k]:
                    found = True
                    near, far = targets[k] - below, below + weight - targets[k]
                    if min(near, far) <= tolerance or shift == 0:
                        out[k] = (cell << shift) if near <= far else ((cell + 1) << shift)
                        del open_[k]
                    else:
                        open_[k] = (cell, below)
                    break
                below += weight
            if not found:  # the target is the whole weight or more
                out[k] = (prefix + 1) << (shift + step)
                del open_[k]
    return [out[k] for k in range(len(targets))]
