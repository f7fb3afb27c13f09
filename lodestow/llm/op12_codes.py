"""Vector code compression: product codes by Lloyd's rounds over whole numbers, pruned with Hamerly's two bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded, keep
from ._vectors import finite, matrix, width

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_LONG = (1 << 63) - 1
#: Bounds are kept on their safe side of every rounding of doubles by this factor.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def _exact(step: int) -> float:
    """Whole components below this size have squared distances over so many components that doubles hold exactly; beyond, Python's integers do."""
    return (2.0**51 / max(step, 1)) ** 0.5


def whole(column: pa.ListArray, dim: int) -> np.ndarray:
    """floor(1024 x) of each component: exact in doubles, as 1024 is a power of two; a component whose product would overflow becomes a Python integer."""
    x = matrix(column, dim)
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    if not out.size or np.abs(out).max() < _exact(dim // PARTS):
        return out
    return np.array([[int(np.floor(v * SCALE)) if abs(v) < 1e300 else int(v) * SCALE for v in row] for row in x.tolist()], dtype=object)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(x, dtype=np.float64))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, exact: whole numbers below 2**53 on the way, or Python integers."""
    if a.dtype == object or b.dtype == object:
        return np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=object).reshape(len(a), len(b))
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def _own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the row beside it."""
    d = a - b
    return (d * d).sum(1)


def _scan(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, ties to the lower index, the distance to it, and to the nearest of the others."""
    codes, near, second = np.empty(len(points), np.int64), np.empty(len(points)), np.empty(len(points))
    for k in range(0, len(points), 2048):
        d = squared(points[k : k + 2048], book)
        at = np.arange(len(d))
        code = d.argmin(1)
        best = d[at, code]
        codes[k : k + 2048], near[k : k + 2048] = code, _root(best)
        if len(book) == 1:
            second[k : k + 2048] = np.inf
        else:
            d = d.astype(np.float64)
            d[at, code] = np.inf
            second[k : k + 2048] = _root(d.min(1))
    return codes, near, second


def reassign(points: np.ndarray, book: np.ndarray, moved: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after the entries moved by those distances, and how many points took a scan of all entries.

    upper bounds a point's distance to its entry from above, lower that to any other entry from below. A point keeps its entry if upper is
    strictly below lower or below half the distance from its entry to the nearest other one: then every other entry is strictly farther, so a tie can't be missed.
    """
    gaps = np.asarray(squared(book, book), dtype=np.float64)
    np.fill_diagonal(gaps, np.inf)
    half = _root(gaps.min(1)) / 2 * _DOWN if len(book) > 1 else np.full(1, np.inf)
    order = np.argsort(-moved)
    most = np.where(np.arange(len(book)) == order[0], moved[order[1]] if len(book) > 1 else 0.0, moved[order[0]])
    upper, lower = (upper + moved[codes]) * _UP, np.maximum(lower - most[codes], 0) * _DOWN
    bound = np.maximum(half[codes], lower)
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = _root(_own(points[open_], book[codes[open_]])) * _UP
    open_ = open_[~(upper[open_] < bound[open_])]
    codes = codes.copy()
    found, near, second = _scan(points[open_], book)
    codes[open_], upper[open_], lower[open_] = found, near * _UP, second * _DOWN
    return codes, upper, lower, len(open_)


_STATE = "vec_id bigint, label {label}, vector {vector}, codes binary, upper binary, lower binary"


def _pass(books: list[np.ndarray], moved: list[np.ndarray] | None, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round over the state; without moved, the first: every point is scanned against all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch["vector"], dim)
            n, step = len(x), dim // PARTS
            read = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(n, PARTS).copy()
            codes, upper, lower = (np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS)), np.zeros((n, PARTS))) if moved is None else (read("codes", np.uint8), read("upper", np.float64), read("lower", np.float64))
            for p in range(PARTS):
                points = x[:, p * step : (p + 1) * step]
                if moved is None:
                    code, u, s = _scan(points, books[p])
                    codes[:, p], upper[:, p], lower[:, p] = code, u * _UP, s * _DOWN
                else:
                    code, upper[:, p], lower[:, p], _ = reassign(points, books[p], moved[p], codes[:, p].astype(np.int64), upper[:, p], lower[:, p])
                    codes[:, p] = code
            raw = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (codes, upper, lower)]
            yield pa.record_batch([batch["vec_id"], batch["label"], batch["vector"], *raw], names=["vec_id", "label", "vector", "codes", "upper", "lower"])

    return run


def _sums(dim: int, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's points add up to at each entry: its count and a sum for each component, as decimal text, so that no size overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = dim // PARTS
        counts, sums = [np.zeros(k, np.int64) for k in sizes], [np.zeros((k, step), object) for k in sizes]
        for batch in batches:
            x = whole(batch["vector"], dim)
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(len(x), PARTS)
            for p in range(PARTS):
                part = np.zeros((sizes[p], step), x.dtype)
                np.add.at(part, codes[:, p], x[:, p * step : (p + 1) * step])
                counts[p] += np.bincount(codes[:, p], minlength=sizes[p])
                sums[p] += np.vectorize(int, otypes=[object])(part) if part.size else part.astype(object)
        rows = [(p, k, c, [str(int(v)) for v in sums[p][k]]) for p in range(PARTS) for k, c in enumerate(counts[p].tolist()) if c]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["part", "entry", "n", "total"])

    return run


def _moved(state: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Each entry replaced by the floor of its points' mean; an entry without points stays. A row an entry and component comes to the driver."""
    parts = state.select("vector", "codes").mapInArrow(_sums(dim, [len(b) for b in books]), "part int, entry int, n bigint, total array<string>")
    n = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    total = parts.select("part", "entry", F.posexplode("total").alias("place", "v")).groupBy("part", "entry", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [b.astype(object) for b in books]
    for r in total.join(n, ["part", "entry"]).collect():  # 4 x 256 x dim / 4 rows at most
        out[r.part][r.entry][r.place] = int(r.v) // r.n
    return [_plain(b) for b in out]


def _plain(book: np.ndarray) -> np.ndarray:
    """As doubles where they are exact."""
    return book.astype(np.float64) if all(abs(v) < _exact(book.shape[1]) for v in book.ravel().tolist()) else book


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray], int]:
    """The state after the last assignment (vec_id, label, vector, codes, upper, lower), the codebooks, and the components of a vector.

    Each assignment writes the state to the shared folder, with an upper and a second-nearest lower bound for each part. Tasks get the codebooks
    (a fixed size) and send back a sum for each entry; nothing else moves, and no row is shuffled. See ``compress`` for odd rows.
    """
    usable = vectors.where(finite(F.col("embedding")))
    dim = -(-width(vectors) // PARTS) * PARTS
    rows = usable.select("vec_id", "label", F.col("embedding").alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # the codebooks' start
    start = whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), dim) if first else np.zeros((1, dim))
    books = [_plain(b.astype(object)) for b in np.split(start, PARTS, axis=1)]
    kinds = dict(rows.dtypes)
    schema = _STATE.format(label=kinds["label"], vector=kinds["vector"])
    state = keep(rows.mapInArrow(_pass(books, None, dim), schema), "codes")
    for _ in range(rounds):
        new = _moved(state, books, dim)
        moved = [_root(_own(a, b)) * _UP for a, b in zip(new, books, strict=True)]
        books = new
        state = keep(state.mapInArrow(_pass(books, moved, dim), schema), "codes")
    return state, books, dim


def _errors(books: list[np.ndarray], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = dim // PARTS
        for batch in batches:
            x = whole(batch["vector"], dim)
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(len(x), PARTS)
            error = sum(_own(x[:, p * step : (p + 1) * step], books[p][codes[:, p]]) for p in range(PARTS)) if len(x) else []
            text = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.record_batch([batch["vec_id"], batch["label"], text, pa.array([min(int(e), _LONG) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each usable row of vectors(vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are left out. A vector shorter than the longest, or than its next multiple of
    4, counts as filled up with zeros. Rows that repeat an id are rows of their own; null ids come after all others when the codebooks start, equal
    ids by their vectors. With fewer rows than entries the codebooks are so much smaller; an empty table gives no rows. An error beyond a long is
    the largest long. Whole components beyond some 10**7 are computed with Python's integers: exact, but slow.
    """
    state, books, dim = train(vectors, rounds, entries)
    schema = f"vec_id bigint, label {dict(state.dtypes)['label']}, code string, error bigint"
    return state.select("vec_id", "label", "vector", "codes").mapInArrow(_errors(books, dim), schema), books


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([np.asarray(b[k], dtype=np.float64) for b, k in zip(books, bytes.fromhex(code), strict=True)]) / SCALE


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def op12_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings; label_error adds up a label's errors, null labels together."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = keep(coded, "coded")
    sums = keep(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")), "labels").select(F.col("label").alias("_of"), F.least("label_error", F.lit(_LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    out = coded.join(bounded(sums), F.col("label").eqNullSafe(F.col("_of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
