"""Filter interaction audit: every order of five filters, run as one trie over persisted survivors."""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import keep, shared_dir

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions of filters A to D on a text that is not null, as boolean columns; built-in functions only.

    Words are maximal runs without U+0020 and U+0009 to U+000D, so the other white space is made a blank and runs of blanks give empty strings.
    """
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, _CAPITALS, ""))
    # Two sizes of one array in a struct, so that the text is split once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return {
        "A": counts["n"] < MIN_WORDS,
        "B": 100 * counts["d"] < MIN_DISTINCT_PERCENT * counts["n"],
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.char_length(text),
        "D": F.char_length(F.translate(text, SYMBOLS, "")) < F.char_length(text),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails_A ... fails_E, good, toxic), a row for each row of docs(doc_id, text, source); the texts are read once and stay where they are.

    E is decided by the smallest id of each text, found with a sum-like minimum before anything is shuffled; only texts met twice are joined, by
    a hash of 256 bits, and a text that a third of all rows share is a skewed join that Spark splits, as its other side is one row.
    A null text is an empty one, a null source the part ''. A row without id has no labels, is no copy of a smaller id and makes no other row one.
    Rows that repeat an id are rows of their own; labels that repeat an id count as one that holds the largest of each value.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_text"), F.struct(*(c.alias(f"fails_{k}") for k, c in text_failures(text).items())).alias("_f"))
    rows = keep(rows.select("_id", "part", "_text", "_f.*"), "read")
    first = rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = rows.join(first, "_text", "left").join(marks, "_id", "left")
    return out.select("part", *(f"fails_{k}" for k in "ABCD"), F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).alias("fails_E"), *(F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic")))


def audit_edges(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, state, filter, survivors, removed, good_lost, toxic_lost): what each filter removes from the survivors of each set of filters.

    rows(part, fails_X ..., good, toxic). state has bit k for the k-th filter. The trie of orders is walked depth first: a node's survivors are a
    persisted DataFrame made of its parent's, and go when the walk leaves it, so at most one path is held. Orders that reach the same set meet in
    one state, which is run once. What a state's filters remove is counted on its survivors by part, summed before the shuffle, and written.
    A part without survivors in a state has no row there.
    """
    spark, done, path = rows.sparkSession, set(), f"{shared_dir(rows.sparkSession)}/lodestow/edges-{uuid.uuid4().hex}"
    schema = "part string, state int, filter string, survivors bigint, removed bigint, good_lost bigint, toxic_lost bigint"

    def visit(state: int, survivors: DataFrame) -> None:
        done.add(state)
        ahead = [k for k in range(len(filters)) if not state >> k & 1]
        if not ahead:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        edges = [F.struct(F.lit(filters[k]).alias("filter"), F.count("*").alias("survivors"), *(F.count_if(F.expr(f"fails_{filters[k]} AND {c}")).alias(n) for n, c in (("removed", "true"), ("good_lost", "good"), ("toxic_lost", "toxic")))) for k in ahead]
        counted = survivors.groupBy("part").agg(F.array(*edges).alias("edges")).select("part", F.lit(state).alias("state"), F.inline("edges"))
        counted.write.mode("append").parquet(path)  # some rows a part
        for k in ahead:
            if state | 1 << k not in done:
                visit(state | 1 << k, survivors.where(f"NOT fails_{filters[k]}"))
        survivors.unpersist()

    visit(0, rows)
    return spark.read.schema(schema).parquet(path)


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    removed is what the step's filter took out of the survivors of the filters before it, whatever their order: an edge of the trie. redundant are
    the part's rows that fail the filter and had gone, unique_fails those that fail it alone, shapley the filter's removed over all orders.
    An empty table gives no rows. A part has a row for each order and step, zeros included; only counts by part leave the tasks, and
    the orders and steps that all parts share are the one thing sent to them.
    """
    spark = docs.sparkSession
    rows = keep(failures(docs, labels), "failures")
    edges = keep(audit_edges(rows, filters), "edges")
    steps = [("".join(order), k + 1, f, sum(1 << filters.index(x) for x in order[:k])) for order in permutations(filters) for k, f in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    alone = {f: F.expr(" AND ".join(f"{'' if g == f else 'NOT '}fails_{g}" for g in filters)) for f in filters}
    parts = rows.groupBy("part").agg(F.array(*(F.struct(F.lit(f).alias("filter"), F.count_if(f"fails_{f}").alias("fails"), F.count_if(alone[f]).alias("unique_fails")) for f in filters)).alias("p")).select("part", F.inline("p"))
    weights = orders.groupBy("state", "filter").agg(F.count("*").alias("orders"))
    total = edges.join(F.broadcast(weights), ["state", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    of = parts.join(total, ["part", "filter"], "left").join(F.broadcast(orders), "filter").join(edges, ["part", "state", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return of.select(
        "part", "filter_order", "step", zero(F.col("survivors") - F.col("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"), "unique_fails",
        zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )


def op11_permutation_trie_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
