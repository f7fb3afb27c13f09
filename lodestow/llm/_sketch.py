"""Fixed-size count tables over hashed features: summed over all rows, small enough to send to every task."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PIECE = 1 << 15
_SCHEMA = "piece int, counts binary"
_ARROW = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])


def _rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    pieces = [(k, part) for k, part in enumerate(table.reshape(-1, _PIECE)) if part.any()]
    for k, part in pieces:
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=_ARROW)


def count_table(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """Sum over all rows of df of what add(batch, table) adds to a zeroed int64 table of that size (a multiple of 32,768).

    Each task sends the pieces of its own table, compressed; pieces meet by their number, so what one
    task sums and what reaches the driver depend on size alone, not on the rows.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.int64)
        for batch in batches:
            add(batch, table)
        yield from _rows(table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=_ARROW)

    merged = df.mapInArrow(fill, _SCHEMA).repartition(min(32, size // _PIECE), "piece").mapInArrow(merge, _SCHEMA)
    table = np.zeros(size, dtype=np.int64)
    for row in merged.collect():  # size / 32,768 rows at most
        table[row.piece * _PIECE : (row.piece + 1) * _PIECE] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return table
