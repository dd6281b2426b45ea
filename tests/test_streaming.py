from datetime import datetime, timedelta

import pytest

from siftlake.streaming import events as ev


@pytest.fixture()
def edits(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(i, start + timedelta(milliseconds=ms), "a" if i % 2 else "b", i) for i, ms in enumerate([0, 100, 200, 300, 400, 2000, 2100, 5000, 90_000_000])]
    rows.append(rows[2])
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, uri string, version long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path)


def test_dedup(spark, edits):
    df, stream, folder = edits
    ev.run_available(ev.deduplicated(stream, ["event_id"], late="2 days"), folder, "out")
    assert spark.read.parquet(folder + "/out").count() == 9 == df.distinct().count()


def test_debounce(spark, edits):
    _, stream, folder = edits
    ev.run_available(ev.debounced(stream, "uri", "version"), folder, "out")
    got = {(r.uri, r.latest, r.n) for r in spark.read.parquet(folder + "/out").collect()}
    # bursts are closed once the watermark has passed them; the last edit of all stays open
    assert {("a", 3, 2), ("b", 4, 4), ("a", 5, 1), ("b", 6, 1), ("a", 7, 1)} == got


def test_rate_limit(spark, edits):
    _, stream, folder = edits
    ev.run_available(ev.limited(stream, "uri", limit=2, seconds=60), folder, "out")
    rows = spark.read.parquet(folder + "/out").collect()
    assert sum(r.allowed for r in rows if r.key == "a") == 2 and sum(r.allowed for r in rows if r.key == "b") == 3


def test_batch_sessions_agree(spark, edits):
    df, _, _ = edits
    got = {(r.uri, r.n) for r in ev.sessions(df.distinct(), "uri", 1).collect()}
    assert got == {("b", 3), ("b", 1), ("a", 2), ("a", 1)}


def test_over_limit(spark, edits):
    df, _, _ = edits
    assert {r.event_id for r in ev.over_limit(df.distinct(), "uri", limit=2, seconds=1).collect()} == {4}
