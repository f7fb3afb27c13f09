"""I-Match document fingerprints over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._select import splitters
from ._store import bounded, keep
from ._text import PUNCT, as_long, mix, word_blocks

#: Terms in this share of the distinct texts are in the lexicon: rarer ones are mistakes and names, commoner ones say nothing.
#: The lower bound also bounds the lexicon: distinct terms of a mean document / LOWEST.
LOWEST, HIGHEST = 0.0005, 0.05
#: Subset (level, variant) holds 1 term in 2**level of the lexicon.
LEVELS, VARIANTS = 12, 16
_SALTS = [np.uint64((0x9E3779B97F4A7C15 * (v + 1)) % 2**64) for v in range(VARIANTS)]
_CODES = 1 + LEVELS * VARIANTS


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the distinct terms and the number of its documents that hold them, each one of k copies counting 1 / k."""
    for batch in batches:
        share = 1 / batch.column("copies").to_numpy()
        parts, owner = [], []
        for lo, hi, words, bounds in word_blocks(batch.column("text").to_pylist(), space=PUNCT):
            for k in range(hi - lo):
                parts.append(np.unique(words[bounds[k] : bounds[k + 1]]))
                owner.append(np.full(len(parts[-1]), share[lo + k]))
        terms, at = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_inverse=True)
        df = np.bincount(at, np.concatenate(owner), len(terms)) if parts else np.empty(0)
        yield pa.record_batch([pa.array(as_long(terms)), pa.array(df, pa.float64())], names=["term", "df"])


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the band, by the distinct texts of docs(text): how often a text is repeated changes nothing."""
    marked = docs.select("text", F.xxhash64("text").alias("h"))
    groups = keep(marked.groupBy("h").agg(F.count("*").alias("copies")), "copies")
    n = groups.count()
    again = bounded(groups.where("copies > 1"))
    weighed = marked.join(again, "h", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    # The shares of a text's copies add up to 1 but for rounding.
    found = keep(weighed.mapInArrow(_terms, "term bigint, df double").groupBy("term").agg(F.round(F.sum("df")).cast("bigint").alias("df")), "terms")
    rows = found.where((F.col("df") >= max(1, LOWEST * n)) & (F.col("df") <= max(1, HIGHEST * n))).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def codes(texts: list, lex: np.ndarray) -> np.ndarray:
    """16-bit codes of each text, one a subset, 0 where it holds none of the text's terms.

    The first code is of the whole lexicon. A text without any term of the lexicon is taken with all its terms.
    """
    return _codes(texts, lex)[0]


def _codes(texts: list, lex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As codes, with a mark for each text that was taken with all its terms."""
    whole = np.zeros(len(texts), bool)
    out = np.zeros((len(texts), _CODES), np.uint16)
    for lo, hi, words, bounds in word_blocks(texts, space=PUNCT):
        inside = np.zeros(len(words), bool)
        if len(lex):
            at = np.minimum(np.searchsorted(lex, words), len(lex) - 1)
            inside = lex[at] == words
        terms, owner = [], []
        for k in range(hi - lo):
            own = words[bounds[k] : bounds[k + 1]]
            chosen = own[inside[bounds[k] : bounds[k + 1]]]
            whole[lo + k] = not len(chosen)
            terms.append(np.unique(chosen if len(chosen) else own))  # sorted distinct terms
            owner.append(len(terms[-1]))
        flat, row = np.concatenate(terms), np.repeat(np.arange(hi - lo), owner)
        for v, salt in enumerate(_SALTS):
            drawn = mix(flat ^ salt)
            left, of = np.arange(len(flat)), row
            for level in range(LEVELS + 1):
                if level:
                    here = ((drawn[left] >> np.uint64(level - 1)) & np.uint64(1)) == 0
                    left, of = left[here], of[here]
                elif v:
                    continue
                if not len(left):
                    break
                first = np.flatnonzero(np.diff(of, prepend=-1))
                place = np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))
                # One hash over the sorted terms of the subset, in order.
                digest = mix(np.add.reduceat(mix(flat[left]) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), first))
                out[lo + of[first], 1 + (level - 1) * VARIANTS + v if level else 0] = (digest % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return out, whole


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints; else the share of subsets with equal codes among those that hold a term of either
    text, over the levels at which most subsets hold few terms. Two texts without terms are alike only if both are."""
    same_all = (a == b).all(axis=1)
    some, same = (a != 0) | (b != 0), (a == b) & (a != 0)
    held = some[:, 1:].reshape(len(a), LEVELS, VARIANTS).sum(axis=2)
    equal = same[:, 1:].reshape(len(a), LEVELS, VARIANTS).sum(axis=2)
    sparse = held <= 0.75 * VARIANTS
    sparse[:, -1] = True
    total = (held * sparse).sum(axis=1)
    share = np.divide((equal * sparse).sum(axis=1), total, out=np.zeros(len(a)), where=total > 0)
    return np.where(same_all, 1.0, share)


def _hex(rows: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in rows]


def _edited(text: str, following: str) -> str:
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _compare(sent):
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    nothing = np.empty(0, np.uint64)

    def near(a: np.ndarray, a_whole: np.ndarray, a_texts: list[str], b: np.ndarray, b_whole: np.ndarray, b_texts: list[str]) -> np.ndarray:
        """Likeness; two texts of which only one holds terms of the lexicon are compared by all their terms."""
        out = _likeness(a, b)
        mixed = np.flatnonzero(a_whole != b_whole)
        if len(mixed):
            out[mixed] = _likeness(codes([a_texts[k] for k in mixed], nothing), codes([b_texts[k] for k in mixed], nothing))
        return out

    def finish(rows: list[tuple], lex: np.ndarray) -> pa.RecordBatch | None:
        """Rows of one or more stretches in order; each row that has its next row beside it comes out."""
        own, whole = _codes([r[3] for r in rows], lex)
        pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
        if not pairs:
            return None
        edited = [_edited(rows[k][3], rows[k + 1][3]) for k in pairs]
        other, other_whole = _codes(edited, lex)
        mine, following = own[pairs], own[[k + 1 for k in pairs]]
        texts, after = [rows[k][3] for k in pairs], [rows[k + 1][3] for k in pairs]
        near_next = near(mine, whole[pairs], texts, following, whole[[k + 1 for k in pairs]], after)
        near_edited = near(mine, whole[pairs], texts, other, other_whole, edited)
        apart = np.flatnonzero(whole[pairs] & ~other_whole)  # the fingerprint of the edited text is of the kind of the text's own
        other[apart] = codes([edited[k] for k in apart], nothing)
        return pa.record_batch(
            [
                pa.array([rows[k][2] for k in pairs], pa.int64()), pa.array([len(rows[k][3]) for k in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
                pa.array(_hex(mine)), pa.array(_hex(other)), pa.array(near_edited), pa.array(near_next),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, last = sent.value, []
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = last + list(zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "id", "text")), strict=True))
                if (done := finish(rows, lex)) is not None:
                    yield done
                last = rows[-1:]

    return run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut docs(id) into so many ranges of rows, even to a quarter, by exact counts; 16 neighbouring ids stay together."""
    keys = docs.where("id IS NOT NULL").select((F.shiftright("id", 4) + F.lit(1 << 59)).alias("key"), F.lit(1).cast("bigint").alias("weight"))
    n = keys.count() if parts > 1 else 0
    found = splitters(keys, [n * k // parts for k in range(1, parts)], n // (4 * parts)) if n else []
    return sorted({(b - (1 << 59)) << 4 for b in found})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint of each document, of its text edited with the next document's, and their likeness.

    Texts are compared by terms of one kind: of the lexicon, or all of them where one of the two has none of the lexicon.

    Documents are dealt once, by ranges of the id; each range also gets the first document of the next one, so that
    every document finds its successor in its own task.

    Null text: empty, with an empty fingerprint. Rows that repeat an id follow one another in order of their text. Null ids
    come first. One document is its own successor. Empty table: no rows.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(docs))
    bounds = _bounds(docs, parts)
    part = F.expr("0" + "".join(f" + coalesce(int(id >= {b}L), 0)" for b in bounds))
    dealt = docs.withColumn("part", part).withColumn("ghost", F.lit(False))
    firsts = docs.groupBy(part.alias("part")).agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("f")).select("part", F.col("f.id").alias("first")).orderBy("part").collect()  # a row a range
    if not firsts:
        return dealt.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))))
    follow = [(firsts[(k + 1) % len(firsts)]["first"], firsts[k]["part"]) for k in range(len(firsts))]
    wanted = spark.createDataFrame(follow, "first bigint, to int")
    ghosts = docs.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("first"))).select("id", "text", F.col("to").alias("part"), F.lit(True).alias("ghost"))
    rows = dealt.unionByName(ghosts).repartition(parts, "part").sortWithinPartitions("part", "ghost", "id", "text")
    return rows.select("part", "ghost", "id", "text").mapInArrow(*_compare(sent)).withColumnRenamed("id", id_col)


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
