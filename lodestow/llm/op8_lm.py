"""Backoff language model as a weighted automaton with failure arcs, trained on the corpus it scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import keep
from ._text import as_long, mix, word_blocks

ORDER = 3
#: n-grams that occur so often are states, at any input size.
LEAST = 2
#: States of this share of the training tokens or more are sent to every task: 1 / SHARE of each length at most. The others are joined.
SHARE = 1e-6
DISCOUNT = 0.75
PRIOR = 0.1
#: Bits of a table that says which hashes may be states; a false hit costs time only. They come in pieces.
_BITS, _PIECE = 1 << 27, 1 << 22
_AT_ONCE = 2_000_000
_END = np.uint64(0x1F83D9ABFB41BD6B)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tokens(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_blocks, with an end token after each text's words."""
    for lo, hi, words, bounds in word_blocks(texts):
        out = np.full(len(words) + hi - lo, _END, np.uint64)
        out[np.arange(len(words)) + np.repeat(np.arange(hi - lo), np.diff(bounds))] = words
        yield lo, hi, out, bounds + np.arange(hi - lo + 1)


def _ending_at(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order the hash of the n tokens that end at each place, 0 where the text holds fewer."""
    out = [tokens]
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    for n in range(2, order + 1):
        longer = np.zeros_like(tokens)
        longer[1:] = mix(out[-1][:-1] * np.uint64(0xA0761D6478BD642F) + tokens[1:])
        longer[place < n - 1] = 0
        out.append(longer)
    return out


class Table:
    """A read-only map from 64-bit keys to rows of values: a bit per key's low bits, then a binary search."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]
        self.bits = max(16, int(len(keys)).bit_length() + 3)
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def packed(self) -> tuple[np.ndarray, ...]:
        return (self.keys, *self.values)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        some = np.flatnonzero(self.maybe[(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        good = self.keys[at] == keys[some]
        out[some[good]] = at[good]
        return out


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Packed bits, set at the low bits of each hash of hashes(hash). Each piece is made in one task, whatever the number of hashes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            for k in np.unique(at // _PIECE).tolist():
                pieces.setdefault(k, np.zeros(_PIECE, bool))[at[at // _PIECE == k] % _PIECE] = True
        for k, piece in pieces.items():
            yield pa.record_batch([pa.array([k]), pa.array([zlib.compress(np.packbits(piece, bitorder="little").tobytes(), 1)])], names=["piece", "bits"])

    at = hashes.select(F.col("hash").bitwiseAND(F.lit(_BITS - 1)).alias("at"))
    table = np.zeros(_BITS // 8, np.uint8)
    for row in at.repartition(_BITS // _PIECE, F.shiftright("at", 22)).mapInArrow(fill, "piece bigint, bits binary").collect():  # a row a piece
        table[row.piece * (_PIECE // 8) : (row.piece + 1) * (_PIECE // 8)] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return table


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct tokens, some two million tokens at a time; Spark sums them over tasks."""
    parts: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        words, counts = _summed(parts)
        parts.clear()
        return pa.record_batch([pa.array(as_long(words)), pa.array(counts)], names=["hash", "c"])

    for batch in batches:
        parts.extend(tokens for _, _, tokens, _ in _tokens(batch.column("text").to_pylist()))
        if sum(map(len, parts)) > _AT_ONCE:
            yield out()
    yield out()


def _count_grams(n: int, gate):
    """Counts of distinct n-grams, as context and last token, whose two parts of n - 1 tokens may be states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[np.ndarray] = []
            for _, _, tokens, bounds in _tokens(batch.column("text").to_pylist()):
                own = _ending_at(tokens, bounds, n)
                may = _may_hold(gate.value, own[n - 2])
                good = np.flatnonzero(own[n - 1] != 0)
                good = good[may[good] & may[good - 1]]
                parts.append(np.stack([own[n - 1][good], own[n - 2][good - 1], tokens[good]]))
            whole = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.uint64)
            _, first, counts = np.unique(whole[0], return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(as_long(np.ascontiguousarray(x[first]))) for x in whole[1:]] + [pa.array(counts)], names=["context", "last", "c"])

    return run, "context bigint, last bigint, c bigint"


def _hashed(n: int):
    """Hash of each n-gram and of its last n - 1 tokens; tail: hash of the last n - 2 of its context."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0xA0761D6478BD642F) + b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, tail, last = (batch.column(x).to_numpy().view(np.uint64) for x in ("context", "tail", "last"))
            suffix = last if n == 2 else joined(tail, last)
            columns = [pa.array(as_long(joined(context, last))), pa.array(as_long(suffix)), *(batch.column(x) for x in ("context", "c", "context_c"))]
            yield pa.record_batch(columns, names=["hash", "suffix", "context", "c", "context_c"])

    return run, "hash bigint, suffix bigint, context bigint, c bigint, context_c bigint"


def train(docs: DataFrame, order: int = ORDER, share: float = SHARE) -> dict:
    """Automaton of docs(text), kept distributed: weights(hash, n, c, base, gain), a row a word or state.

    base is log10 P(word), 0 for longer n-grams. The log10 P of a text is the sum of the gains of all n-grams in it: the gain of
    a word is its base and its failure arc; that of a longer n-gram is log10 P(last word | rest) less what the way through its
    context's failure arc would give, and its own failure arc. (A state's parts are states, and the end token has no arcs.)
    """
    spark = docs.sparkSession
    vocabulary = keep(docs.mapInArrow(_count_words, "hash bigint, c bigint").groupBy("hash").agg(F.sum("c").alias("c")), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    scale = total + PRIOR * (distinct + 1)
    lower = vocabulary.select("hash", F.lit(0).cast("bigint").alias("suffix"), "c", F.log10((F.col("c") + PRIOR) / F.lit(scale)).alias("p"))
    own = lower.select("hash", F.lit(1).alias("n"), "c", F.col("p").alias("base"), F.col("p").alias("gain"))
    bits, parts = [bit_table(lower.where(F.col("c") >= LEAST))], []
    for n in range(2, order + 1):
        gate = spark.sparkContext.broadcast(bits[-1])
        counted = docs.select("text").mapInArrow(*_count_grams(n, gate)).groupBy("context", "last").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST)
        found = counted.join(lower.select(F.col("hash").alias("context"), F.col("suffix").alias("tail"), F.col("c").alias("context_c")), "context")
        found = found.mapInArrow(*_hashed(n)).join(lower.select(F.col("hash").alias("suffix"), F.col("p").alias("below")), "suffix")
        grams = keep(found.select("hash", "suffix", "context", "c", F.log10((F.col("c") - DISCOUNT) / F.col("context_c")).alias("p"), "below"), "grams")
        # Absolute discount: what the n-grams of a context give up goes to its failure arc, less what they have below it.
        left = lambda x: F.greatest(1 - F.sum(F.pow(F.lit(10.0), x)), F.lit(1e-9))
        arcs = keep(grams.groupBy("context").agg(F.log10(left("p") / left("below")).alias("arc")), "arcs")
        parts.append(own.join(arcs.withColumnRenamed("context", "hash"), "hash", "left").select("hash", "n", "c", "base", (F.col("gain") + F.coalesce("arc", F.lit(0.0))).alias("gain")))
        own = grams.join(arcs, "context").select("hash", F.lit(n).alias("n"), "c", F.lit(0.0).alias("base"), (F.col("p") - F.col("below") - F.col("arc")).alias("gain"))
        lower = grams
        bits.append(bit_table(grams))
        gate.unpersist()
    weights = own
    for part in parts:
        weights = weights.unionByName(part)
    weights = keep(weights, "weights")
    hot = max(LEAST, math.ceil(share * total))
    got = weights.where(F.col("c") >= hot).toPandas()  # order / share rows at most
    tables = [Table(g["hash"].to_numpy(np.int64).view(np.uint64), g["base"].to_numpy(), g["gain"].to_numpy()) for g in (got[got["n"] == n] for n in range(1, order + 1))]
    return {"tables": tables, "bits": bits, "weights": weights.where(F.col("c") < hot), "tokens": total, "distinct": distinct}


_SCORE = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("frequent", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _traverse(tables: list[Table], bits: list[np.ndarray], tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: is it in the table of words, its base and the gains of the n-grams that end there, as far as the tables
    hold them. Of each word and possible state that they do not hold: its hash and place, in order of place."""
    own = _ending_at(tokens, bounds, len(tables))
    base, gain, known = np.zeros(len(tokens)), np.zeros(len(tokens)), np.zeros(len(tokens), bool)
    hashes, places = [], []
    may = np.ones(len(tokens), bool)
    for n, table in enumerate(tables, 1):
        at = np.flatnonzero((own[n - 1] != 0) & may & np.concatenate(([True], may[:-1])))
        if n > 1:
            at = at[_may_hold(bits[n - 1], own[n - 1][at])]
            may = np.zeros(len(tokens), bool)
            may[at] = True
        row = table.find(own[n - 1][at])
        found = row >= 0
        held, row = at[found], row[found]
        base[held] += table.values[0][row]
        gain[held] += table.values[1][row]
        if n == 1:
            known[held] = True
        rest = at[~found]
        hashes.append(own[n - 1][rest])
        places.append(rest)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return known, base, gain, np.concatenate(hashes)[order], place[order]


def _score_batch(tables: list[Table], bits: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[], [], [], [], [], []]
    for lo, hi, tokens, bounds in _tokens(batch.column("text").to_pylist()):
        known, base, gain, hashes, places = _traverse(tables, bits, tokens, bounds)
        for x, y in zip(out, (np.diff(bounds), *(np.add.reduceat(v, bounds[:-1]) for v in (known.astype(np.int64), base, gain))), strict=False):
            x.extend(y.tolist())
        cuts = np.searchsorted(places, bounds)
        for k in range(hi - lo):
            rare, times = np.unique(hashes[cuts[k] : cuts[k + 1]], return_counts=True)
            out[4].append(as_long(rare))
            out[5].append(times)
    return pa.record_batch([batch.column("row"), *(pa.array(x, f.type) for x, f in zip(out, list(_SCORE)[1:], strict=True))], schema=_SCORE)


def score(docs: DataFrame, training: DataFrame, order: int = ORDER, share: float = SHARE) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score of its column text; training(text).

    Words and states below the share that is sent to every task get their exact weights by a join on their hash; those
    weights never leave the executors. What is a state does not depend on share or on the size of the input.

    Null or blank text: one token, the end. No training rows: every token is unknown and has the prior of the one unseen word.
    Rows that repeat are scored each. Columns of docs of those names are replaced.
    """
    spark = docs.sparkSession
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*(c for c in new if c in docs.columns))
    model = train(training, order, share)
    tables, bits = spark.sparkContext.broadcast([t.packed() for t in model["tables"]]), spark.sparkContext.broadcast(model["bits"])
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    others = [c for c in docs.columns if c != "text"]
    # The ids and the scores of a row are made in one task, so both come from one reading of it.
    schema = "row bigint, n_tokens bigint, frequent bigint, base double, score double, rare array<bigint>, times array<bigint>"
    row = F.col("__row").alias("row")
    passed = numbered.select(row, "text", F.struct(*others).alias("rest")) if others else numbered.select(row, "text")

    def with_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = [Table(*x) for x in tables.value]
        for batch in batches:
            got = _score_batch(automaton, bits.value, batch)
            yield got.append_column("rest", batch.column("rest")) if "rest" in batch.schema.names else got

    rest = ", rest " + passed.schema["rest"].dataType.simpleString() if others else ""
    scored = keep(passed.mapInArrow(with_rest, schema + rest), "scored")
    scale = model["tokens"] + PRIOR * (model["distinct"] + 1)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("hash"), F.col("r.times").alias("t"))
    # Every rare word is first taken as unknown.
    unknown = F.lit(math.log10(PRIOR / scale))
    first = F.when(F.col("n") == 1, unknown).otherwise(F.lit(0.0))
    sums = rare.join(model["weights"], "hash").groupBy("row").agg(
        F.sum(F.col("t") * (F.col("base") - first)).alias("more_base"), F.sum(F.col("t") * (F.col("gain") - first)).alias("more"), F.sum(F.when(F.col("n") == 1, F.col("t")).otherwise(0)).alias("seen")
    )
    out = scored.drop("rare", "times").join(sums, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    least = (F.col("n_tokens") - F.col("frequent")) * unknown
    return out.select(
        *(["rest.*"] if others else []), "n_tokens", (F.col("frequent") + zero("seen")).cast("bigint").alias("n_known"), F.lit(model["tokens"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + least + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + least + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score(docs, docs.where(~F.col("held_out")).select("text")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
