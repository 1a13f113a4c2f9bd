import time

from pyspark.sql import functions as F

from siltstone.streaming import events as ev

LOG = [
    ("add", "./a.ts", "2026-01-01 00:00:00.0"), ("change", "a.ts", "2026-01-01 00:00:00.3"), ("change", "a.ts", "2026-01-01 00:00:00.3"), ("unlink", "/r/b.ts", "2026-01-01 00:00:05"),
    (None, "c", "2026-01-01 00:00:00"), ("add", None, "2026-01-01 00:00:00"), ("add", "d", None), ("Change", "e\\f.ts", "2026-01-01 02:00:00"),
]


def log(spark, rows=LOG):
    return spark.createDataFrame(rows, "event_type string, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_clean(spark):
    got = {(r["event_type"], r["path"]) for r in ev.clean_events(log(spark), "/r").collect()}
    assert got == {("add", "a.ts"), ("change", "a.ts"), ("unlink", "b.ts"), ("change", "e/f.ts")}


def test_bursts(spark):
    got = {(r["path"], r["events"], tuple(r["event_types"])) for r in ev.bursts(ev.clean_events(log(spark), "/r")).collect()}
    assert got == {("a.ts", 3, ("add", "change")), ("b.ts", 1, ("unlink",)), ("e/f.ts", 1, ("change",))}


def test_batches_over_ranges_of_time(spark):
    rows = [("add", f"p{i}", f"2026-01-01 0{h}:59:59.{i}" if i < 9 else f"2026-01-01 0{h + 1}:00:00.1") for h in (0, 3) for i in (1, 9)] + [("add", "late", "2026-01-01 09:00:00")]
    got = ev.debounced_batches(ev.clean_events(log(spark, rows)), 1.0).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 2]
    assert ev.debounced_batches(ev.clean_events(log(spark, []))).count() == 0


def test_order(spark):
    df = spark.createDataFrame([("unlink", "a"), ("add", "z"), ("change", "b"), ("add", "z")], "event_type string, path string")
    assert [tuple(r) for r in ev.in_order(df).collect()] == [("add", "z"), ("change", "b"), ("unlink", "a")]


def test_stream_applies_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    ev.clean_events(log(spark), "/r").coalesce(1).write.parquet(folder)
    seen, told = [], []
    listener = ev.progress_listener(spark, told.append)
    q = ev.apply_batches(ev.read_events(spark, folder), lambda df, i: seen.append((i, [tuple(r) for r in df.collect()])), str(tmp_path / "cp"))
    q.awaitTermination(90)
    assert seen[0][1][0][0] == "add" and len(seen) == 1
    for _ in range(100):
        if {"batch", "done"} <= {t["phase"] for t in told}:
            break
        time.sleep(0.2)
    assert {"started", "batch", "done"} <= {t["phase"] for t in told}
    spark.streams.removeListener(listener)


def test_progress():
    assert ev.progress(0, 0) == (100, "=" * 10) and ev.progress(5, 10) == (50, "=====>    ") and ev.progress(0, 4)[1] == ">" + " " * 9


def test_stream_bursts_and_flush(spark, tmp_path):
    folder = str(tmp_path / "in")
    ev.clean_events(log(spark), "/r").coalesce(1).write.parquet(folder)
    s = ev.stream_bursts(ev.read_events(spark, folder)).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    s.awaitTermination(90)
    assert spark.table("bursts").where("path = 'a.ts'").count() == 1
    grouped = ev.read_events(spark, folder).withColumn("group", F.lit(0).cast("long"))
    f = ev.flush_by_count(grouped, at=2).writeStream.format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    f.awaitTermination(90)
    got = [tuple(r) for r in spark.table("flushes").orderBy("batch").collect()]
    assert [r[2:] for r in got if r[1] == 0] == [("add", "a.ts"), ("change", "a.ts")] and all(r[0] == 0 for r in got)


def test_watcher_tells_what_happened(spark, tmp_path):
    state = [[("a", 1, "2026-01-01"), ("b", 1, "2026-01-01"), (None, 1, None)], [("a", 2, "2026-01-02"), ("c", 1, None)], [("a", 2, "2026-01-02"), ("c", 1, None)]]
    w = ev.Watcher(spark, str(tmp_path / "w"), lambda: spark.createDataFrame(state[0], "path string, size long, modified_at string").withColumn("modified_at", F.col("modified_at").cast("timestamp")))
    assert w.poll() == {"add": 0, "change": 0, "unlink": 0}
    state.pop(0)
    assert w.poll() == {"add": 1, "change": 1, "unlink": 1}
    state.pop(0)
    assert w.poll() == {"add": 0, "change": 0, "unlink": 0} and w.counts["unlink"] == 1
    seen = []
    ev.apply_batches(ev.read_events(spark, w.events), lambda df, i: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(90)
    assert seen == [("add", "c"), ("change", "a"), ("unlink", "b")]
