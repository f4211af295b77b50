"""Streaming operators driven to the end over files."""

from citewright.streaming import events


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def source(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_requests_once(spark, tmp_path):
    df = source(spark, tmp_path, [[("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01")], [("a", "2024-01-01 00:00:02")]], "id string, ts string")
    assert sorted(r.id for r in run(events.once(df), spark, "once")) == ["a", "b"]


def test_paced_and_reset(spark, tmp_path):
    calls = source(spark, tmp_path, [[("h", 1, 0.0, 5.0), ("h", 2, 0.0, 40.0), ("h", 3, 0.0, 5.0)]], "host string, call_id long, arrival double, duration double")
    assert sorted((r.call_id, r.start) for r in run(events.paced(calls, 30.0), spark, "paced")) == [(1, 0.0), (2, 30.0), (3, 70.0)]
    frames = source(spark, tmp_path / "f", [[("s", "p1", 1), ("s", "p1", 2), ("s", "p2", 3)]], "session string, page_id string, seq long")
    assert sorted((r.seq, r.generation) for r in run(events.sessions_reset(frames), spark, "frames")) == [(1, 0), (2, 0), (3, 1)]


def test_progress_and_replay(spark, tmp_path):
    results = source(spark, tmp_path, [[("j", True), ("j", False)], [("j", True)]], "job string, ok boolean")
    assert max((r.completed, r.failed) for r in run(events.progress(results), spark, "progress", "complete")) == (3, 1)
    frames = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 1)], "session string, seq long")
    acks = spark.createDataFrame([("s", 1)], "session string, ack long")
    assert sorted(map(tuple, events.unacknowledged(frames, acks).select("session", "seq").collect())) == [("s", 2), ("t", 1)]
