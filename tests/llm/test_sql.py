"""Operators that SQL can state against DuckDB, and the pipeline's stages on the smallest tables."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as pipeline
from lodestow.llm import queries
from lodestow.llm._store import keep

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    c = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    out = c.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert sorted(out.columns) == names
    order = [out.columns.index(x) for x in names]
    assert sorted(tuple(r[x] for x in names) for r in df.collect()) == sorted(tuple(r[k] for k in order) for r in out.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = keep(stage(spark, docs, DIR), name)
        kept[name] = (docs.collect(), out.collect())
        docs = out
        assert out.columns[:5] == pipeline.COLUMNS
    for name in ("quality", "near_duplicates", "decontaminate"):
        before, after = kept[name]
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    before, after = kept["near_duplicates"]

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(r.text) for r in after]
    assert not any(len(a & b) >= 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    before, after = kept["mixture"]
    words = lambda rows: Counter({s: sum(len(WORD.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    assert abs(sum(words(after).values()) / sum(words(before).values()) - 1.5) < 0.03
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = kept["sharding"]
    assert Counter(tuple(r) for r in before) == Counter(tuple(r)[:5] for r in after)


def test_stages_bear_odd_rows(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0, name
        assert stage(spark, odd, DIR).count() >= 20, name
    assert labels.count()
