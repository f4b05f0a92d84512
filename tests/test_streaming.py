from datetime import datetime as D

from codeloom.session import scratch_path
from codeloom.streaming import events as ev

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows():
    return [(1, D(2025, 1, 1, 0, 5), 1, "a", 1.0), (2, D(2025, 1, 1, 0, 20), 1, "a", 2.0), (3, D(2025, 1, 1, 1, 30), 1, "b", None), (3, D(2025, 1, 1, 1, 40), 1, "b", 4.0), (4, D(2025, 1, 1, 9, 0), 2, "a", 1.0)]


def test_stream_equals_batch(spark):
    folder = scratch_path(spark, "events")
    frame = spark.createDataFrame(rows(), SCHEMA)
    frame.write.parquet(folder)
    stream = ev.windowed(ev.events_stream(spark, folder, frame.schema))
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("windowed").collect()} == {tuple(r) for r in ev.windowed(frame).collect()}
    assert sorted(r.n for r in ev.sessions(frame).collect()) == [1, 2, 2]


def test_merged_versions(spark):
    base = scratch_path(spark, "merge")
    frame = spark.createDataFrame(rows(), SCHEMA)
    frame.limit(3).coalesce(1).write.parquet(base + "/in")
    for _ in range(2):
        ev.merge_batches(ev.events_stream(spark, base + "/in", frame.schema), base + "/out", ["event_id"], "ts", base + "/check").awaitTermination()
        frame.subtract(frame.limit(3)).coalesce(1).write.mode("append").parquet(base + "/in")
    import glob
    last = max(int(p.rsplit("=", 1)[1]) for p in glob.glob(base.replace("file://", "").replace("file:", "") + "/out/version=*"))
    got = {r.event_id: r.value for r in spark.read.parquet(f"{base}/out/version={last}").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 4.0, 4: 1.0}
