import pytest
from pyspark.sql import functions as F

from siltstone.operators import incremental, maintenance, observe


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


STATE = [
    ("run:1", '{"status": "idle"}'), ("run:2", '{"status": "rolled_back"}'), ("run:3", '{"status":"error"}'),
    ("file:a", '{"hash":"AA","run":1,"state":"done"}'), ("file:a", "run=2;state=done;hash=bb"),
    ("file:b", " hash=CC ; run=3 ; state=DONE "), ("file:b", '{"hash":"dd","run":"4","state":"started"}'),
    ("file:c", '{"hash":"ee","run":1,"state":"failed"}'), ("file:d", None), (None, "x"), ("file:e", "no run"), ("last_full_sync", "5"),
]
CHUNKS = [
    ("a", "aa", "2026-01-01"), ("a", "zz", "2025-01-01"), ("b", "cc", None), ("c", "ee", "2026-01-01"), ("n", None, "2026-01-01"), ("a", "aa", "2026-01-01"), (None, "aa", "2026-01-01"), ("new", "q", None),
]


def tables(spark, state=STATE, chunks=CHUNKS):
    c = spark.createDataFrame(chunks, "file_path string, file_hash string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp")).withColumn("run", F.lit("clash")).withColumn("v", F.lit(1))
    return c, spark.createDataFrame(state, "key string, value string")


def test_files_to_process(spark):
    assert rows(incremental.files_to_process(*tables(spark)), "file_path") == [("c",), ("n",), ("new",)]


def test_files_to_process_empty(spark):
    assert rows(incremental.files_to_process(*tables(spark, state=[])), "file_path") == [("a",), ("b",), ("c",), ("n",), ("new",)]
    assert rows(incremental.files_to_process(*tables(spark, chunks=[])), "file_path") == []


def test_runner_survives_failures(spark, tmp_path):
    run = incremental.IncrementalRunner(spark, str(tmp_path / "m"))
    first = spark.createDataFrame([("p1", 1, "x"), ("p2", 2, None), ("p1", 1, "x")], "path string, size long, checksum string")
    calls = []

    def fails(df):
        calls.append(df.count())
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(first, fails)
    more = first.union(spark.createDataFrame([("p3", 3, "y")], first.schema))
    name = run.run(more, lambda df: df.distinct())  # the batch that failed comes first, as it was
    assert name and rows(run.output(), "path") == [("p1",), ("p2",)]
    assert run.run(more, lambda df: df) and rows(run.output(), "path") == [("p1",), ("p2",), ("p3",)]
    assert run.run(more, lambda df: df) is None
    changed = spark.createDataFrame([("p1", 1, "z")], first.schema)
    assert run.run(changed, lambda df: df, batch="named") == "named"
    assert run.run(changed, lambda df: df, batch="named") in (None, "named")
    assert run.output().count() == 4


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, size long, checksum string")


def test_runner_between_output_and_commit(spark, tmp_path):
    run = incremental.IncrementalRunner(spark, str(tmp_path / "m"))
    one = listing(spark, ("p", 1, "x"))
    run._stage(one, "b1", 1)
    one.union(one).write.parquet(f"{run.root}/out/batch=b1")  # output of a try that broke off before the commit
    assert run.run(one, lambda df: df) == "b1"
    assert run.output().count() == 1
    run.at.write("note.json", '{"batch": "b1", "staged": "staged/none", "number": 1}')  # committed, but the note stayed
    assert run.run(one, lambda df: df) is None and run.output().count() == 1


def test_runner_takes_content_that_comes_back(spark, tmp_path):
    run = incremental.IncrementalRunner(spark, str(tmp_path / "m"))
    for k, c in enumerate("ABA"):
        assert run.run(listing(spark, ("p", 1, c), ("q", 1, "same")), lambda df: df), k
        assert run.run(listing(spark, ("p", 1, c), ("q", 1, "same")), lambda df: df) is None
    assert run.output().where("path = 'p'").count() == 3 and run.output().where("path = 'q'").count() == 1
    assert run.run(listing(spark, (None, 1, "x")), lambda df: df) is None


def test_runner_loses_no_input_that_is_missing_in_the_retry(spark, tmp_path):
    run = incremental.IncrementalRunner(spark, str(tmp_path / "m"))
    both = listing(spark, ("a", 1, "x"), ("b", 1, "y"))

    def fails(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        run.run(both, fails)
    assert run.run(listing(spark, ("a", 1, "x")), lambda df: df)
    assert rows(run.output(), "path") == [("a",)] and rows(run.pending(both), "path") == [("b",)]
    assert run.run(both, lambda df: df) and rows(run.output(), "path") == [("a",), ("b",)]
    with pytest.raises(RuntimeError):
        run.run(listing(spark, ("c", 1, "x")), fails)
    assert run.run(listing(spark), lambda df: df) is None and not run.at.exists("note.json")


def test_moves_that_fail_raise(spark, tmp_path):
    from siltstone.sources.shared import Folder

    f = Folder(spark, str(tmp_path))
    f.write("a", "1")
    f.write("a", "2")
    assert f.read("a") == "2" and f.read("none") is None
    f.move("a", "b")
    f.move("a", "b")  # done already
    f.write("a", "3")
    with pytest.raises(OSError):
        f.move("a", "b")
    with pytest.raises(OSError):
        f.move("zzz", "c")


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "file_path string, chunk_index int")
    new = spark.createDataFrame([("a", 0)], "file_path string, chunk_index int")
    assert rows(maintenance.upsert_chunks(old, new), "file_path", "chunk_index") == [("a", 0), ("b", 0)]
    assert rows(maintenance.delete_files(old, new), "file_path", "chunk_index") == [("b", 0)]
    assert rows(maintenance.upsert_chunks(old.limit(0), new), "file_path", "chunk_index") == [("a", 0)]


def test_plan_sync(spark):
    e = spark.createDataFrame([("a", "change", "2026-01-01"), ("b", "change", "2026-01-01"), ("b", "unlink", "2026-01-02"), ("c", "add", None), ("d", "add", "2026-01-01"), (None, "add", "2026-01-01"), ("e", None, "2026-01-01")], "path string, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    now = spark.createDataFrame([("a", "h1", 10), ("a", "h1", 10), ("b", "h", 1), ("c", "x", 10), ("d", "y", 10**7)], "file_path string, file_hash string, size long")
    stored = spark.createDataFrame([("a", "h1"), ("c", "old")], "file_path string, file_hash string")
    assert rows(maintenance.plan_sync(e, now, stored), "file_path", "action") == [("a", "unchanged"), ("b", "delete"), ("c", "upsert"), ("d", "too_big")]


def test_plan_takes_the_newest_version_and_the_committed_hash(spark):
    """An edit that makes a file shorter, a failed and an undone entry with the new hash."""
    c = spark.createDataFrame([("a", "old", "2026-01-01", 1, "x" * 5000), ("a", "NEW", "2026-01-02", 2, "é"), ("a", "NEW", "2026-01-02", 2, "é"), ("b", "h", None, 3, None)], "file_path string, file_hash string, updated_at string, id long, chunk_text string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert rows(incremental.current_files(c), "file_path", "file_hash", "size") == [("a", "new", 2), ("b", "h", 0)]
    state = spark.createDataFrame([("run:3", '{"status": "rolled_back"}'), ("file:a", '{"hash":"old","run":1,"state":"done"}'), ("file:a", '{"hash":"new","run":2,"state":"failed"}'), ("file:a", '{"hash":"new","run":3,"state":"done"}'), ("file:b", '{"hash":"h","run":1,"state":"done"}')], "key string, value string")
    e = spark.createDataFrame([("a", "change", "2026-01-03"), ("b", "change", "2026-01-03")], "path string, event_type string, ts string")
    assert rows(maintenance.plan_sync(e, incremental.current_files(c), incremental.committed_manifest(state)), "file_path", "action") == [("a", "upsert"), ("b", "unchanged")]
    assert incremental.current_files(c.limit(0)).count() == 0


def test_empty_tables(spark):
    m = spark.createDataFrame([], "name string, value double")
    assert observe.metrics_summary(m).count() == 0
    assert observe.cache_stats(m).first().asDict() == {"hits": 0, "misses": 0, "hit_rate": 0.0}
    c = spark.createDataFrame([], "id long, file_path string")
    assert observe.index_stats(c).first()["files"] == 0
    assert observe.bm25_tf(spark.createDataFrame([], "d long, t string"), "d", "t", "x y").count() == 0


def test_keep_latest_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "t int, k string")
    assert [r["k"] for r in observe.keep_latest(df, 2, ["t", "k"]).collect()] == ["b", "a"]


def test_union_keeps_further_columns_and_all_of_the_third(spark):
    a, b, c = ([(p, n) for p in ps] for ps, n in (("xxy", 1), ("yz", 1), ("zzx", 0)))
    out = maintenance.union_files(*(spark.createDataFrame(r, "path string, n int") for r in (a, b, c)))
    assert rows(out, "path", "n") == [("x", 0), ("x", 1), ("y", 1), ("z", 0), ("z", 0), ("z", 1)]


def test_upsert_of_versions_takes_the_whole_table(spark, data):
    from siltstone.plans import catalogue

    table = spark.read.parquet(f"{data}/chunks.parquet")
    out = catalogue.queries()["upsert_chunks"](spark, data)
    paths = lambda df: {r[0] for r in df.select("file_path").distinct().collect()}
    assert paths(out) == paths(table) and {r[0] for r in out.select("origin").distinct().collect()} == {"old", "new"}
    assert 0 < out.count() < table.count()
