import time

from pyspark.sql import functions as F

from terrane.engine import Engine, Options
from terrane.streaming import windows
from terrane.streaming.watch import Watcher


def test_windows_on_a_stream_equal_those_on_a_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, make in (("tumbling", windows.tumbling), ("sliding", windows.sliding), ("debounced", windows.debounced)):
        out = make(stream, late="10 minutes").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination(120)
        # append mode holds back the windows that the watermark hasn't passed
        columns = [c for c in out.recentProgress and spark.table(name).columns if c != "total"]
        want = {tuple(r) for r in make(events).select(*columns).collect()}
        got = {tuple(r) for r in spark.table(name).select(*columns).collect()}
        assert got and got <= want and len(got) >= 0.9 * len(want)


def test_last_state_and_retries(spark):
    events = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "b", 0, "z")], "event_id long, user_id string, t long, event_type string").withColumn("ts", F.timestamp_seconds("t"))
    assert {(r.user_id, r.event_type) for r in windows.last_state(events).collect()} == {("a", "y"), ("b", "z")}
    attempts = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("b", 4, True), ("c", 1, False)], "path string, seq long, ok boolean")
    assert {tuple(r) for r in windows.with_retries(attempts).collect()} == {("a", 2, "done"), ("b", 3, "dropped"), ("c", 1, "pending")}


def test_watcher(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "first.md").write_text("first words")
    e = Engine(spark, str(tmp_path / "index"), Options(dimensions=32))
    w = Watcher(e, str(root), str(tmp_path / "checkpoint"), debounce_ms=50)
    w.start()
    try:

        def until(condition):
            end = time.time() + 90
            while time.time() < end and not condition():
                time.sleep(0.3)
            return condition()

        (root / "fresh.md").write_text("fresh words")
        assert until(lambda: "fresh.md" in {r.name for r in e.table("files").collect()})
        (root / "fresh.md").unlink()
        assert until(lambda: "fresh.md" not in {r.name for r in e.table("files").collect()})
        assert not w.dropped and w.applied >= 2
    finally:
        w.stop()
