"""Revisioned records and logs."""

from lodestow.operators import revisions

SCHEMA = "k long, o long, kind string, base long, request string, digest string"


def outcome(spark, current, proposals):
    df = revisions.apply_proposals(spark.createDataFrame(current, "k long, revision long"), spark.createDataFrame(proposals, SCHEMA), "k", ["o"])
    return {(r.k, r.o): (r.status, r.revision, r.source) for r in df.collect()}


def test_stale_repeated_reused_and_undone(spark):
    got = outcome(
        spark, [(1, 5)],
        [
            (1, 1, "put", 5, "r1", "a"), (1, 2, "put", 5, "r2", "b"), (1, 3, "put", 5, "r1", "a"), (1, 4, "put", 6, "r1", "z"), (1, 5, "put", 6, None, "c"), (1, 6, "undo", 7, None, "d"), (1, 7, "undo", 8, None, "e"), (1, 8, "put", 9, "r9", None), (1, 9, "put", 9, "r9", None),
            (2, 1, "undo", 0, None, "a"), (2, 2, "put", 0, None, "a"), (2, 3, "undo", 1, None, "a"), (2, 4, "put", None, None, "a"),
        ],
    )
    assert got == {
        (1, 1): ("accepted", 6, 1), (1, 2): ("stale", 6, None), (1, 3): ("repeated", 6, 1), (1, 4): ("reused", 6, None), (1, 5): ("accepted", 7, 5), (1, 6): ("accepted", 8, 1), (1, 7): ("accepted", 9, 5), (1, 8): ("accepted", 10, 8), (1, 9): ("repeated", 10, 8),
        (2, 1): ("nothing_to_undo", 0, None), (2, 2): ("accepted", 1, 2), (2, 3): ("nothing_to_undo", 1, None), (2, 4): ("stale", 1, None),
    }


def test_nothing_to_apply(spark):
    assert outcome(spark, [(1, 5)], []) == {}


def test_a_batch_is_added_once(spark):
    schema = "run string, seq long, body string"
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], schema)
    batch = spark.createDataFrame([("a", 2, "other"), ("a", 4, "z"), ("a", 4, "y"), ("b", 1, "w")], schema)
    added = revisions.append_log(log, batch, ["run", "seq"], ["body"])
    assert sorted(tuple(r) for r in added.collect()) == [("a", 4, "y"), ("b", 1, "w")]
    whole = log.unionByName(added)
    assert revisions.append_log(whole, batch, ["run", "seq"], ["body"]).count() == 0
    assert {tuple(r) for r in revisions.log_snapshot(whole, "run", "seq").collect()} == {("a", 3, 4, 3), ("b", 1, 1, None)}
    assert {tuple(r) for r in revisions.log_snapshot(whole, "run", "seq", since=2).collect()} == {("a", 1, 4, 3)}
