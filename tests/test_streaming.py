import shutil

from lodestow.streaming import events

SOURCE = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(SOURCE, tmp_path / "in" / "a.parquet")
    return events.read(spark, str(tmp_path / "in"))


def test_exactly_once(spark, tmp_path):
    got = events.run_once(events.exactly_once(events.envelope(stream(spark, tmp_path)), "60 days"), "append", "once", str(tmp_path / "c"))
    rows = spark.read.parquet(SOURCE).selectExpr("user_id", "get_json_object(props, '$.k') AS k")
    assert got.count() == rows.distinct().count()
    assert got.where("node IS NULL OR status IS NULL").count() == 0


def test_windows(spark, tmp_path):
    got = events.run_once(events.windowed_counts(stream(spark, tmp_path)), "complete", "windows", str(tmp_path / "c"))
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(SOURCE).count()


def test_tail(spark, tmp_path):
    got = events.run_once(events.tail(stream(spark, tmp_path), 3), "update", "tails", str(tmp_path / "c"))
    expected = {}
    for r in spark.read.parquet(SOURCE).orderBy("event_id").collect():
        expected.setdefault(r.user_id, []).append(r.event_id)
    assert {r.run_id: r.events for r in got.collect()} == {k: v[-3:] for k, v in expected.items()}
