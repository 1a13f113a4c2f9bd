"""What reaches the scan, and where nothing is shuffled."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from siltstone.operators import chunking, incremental, observe, search


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def table(spark, data):
    return spark.read.parquet(f"{data}/chunks.parquet")


def test_prefix_reaches_the_scan(spark, data):
    p = plan(search.knn(table(spark, data), [1.0] * 64, 5, "src/"))
    assert "StringStartsWith(file_path,src/)" in p
    assert re.search(r"ReadSchema: struct<id:bigint,file_path:string,embedding:array<float>>", p)


def test_only_needed_columns_are_read(spark, data):
    assert re.search(r"ReadSchema: struct<id:bigint,file_path:string>", plan(observe.index_stats(table(spark, data))))
    assert "chunk_text" not in plan(incremental.current_versions(table(spark, data)))


def test_top_k_is_no_sort(spark, data):
    assert "TakeOrderedAndProject" in plan(table(spark, data).orderBy("id").limit(3)) and "TakeOrderedAndProject" in plan(search.knn(table(spark, data), [1.0] * 64, 5))


def test_cutting_units_is_no_shuffle(spark, data):
    p = plan(chunking.segments(table(spark, data), "id", "file_path", "chunk_text"))
    assert "Exchange" not in p and "Python" not in p
    assert "Exchange" not in plan(chunking.boundaries(table(spark, data), "id", "file_path", "chunk_text"))


def test_aggregates_are_partial(spark, data):
    p = plan(observe.metrics_summary(spark.read.parquet(f"{data}/metrics.parquet")))
    assert p.count("partial_count") >= 1


def test_anti_join_without_cross_products(spark, data):
    p = plan(incremental.files_to_process(table(spark, data), spark.read.parquet(f"{data}/sync_state.parquet")))
    assert "Cartesian" not in p and "NestedLoop" not in p and "LeftAnti" in p


def test_no_query_has_a_product(spark, data):
    from siltstone.plans import catalogue

    for name in ("hybrid_search", "upsert_chunks", "incremental_sync", "diff_sync", "debounced_batches", "mean_pool", "bm25_tf"):
        p = plan(catalogue.queries()[name](spark, data).where(F.lit(True)))
        assert "Cartesian" not in p and "NestedLoop" not in p, name


def test_keyword_search_reads_the_buckets_of_its_stems(spark, data):
    from siltstone.operators.index import bucket_number, bucket_of
    from siltstone.plans import catalogue

    ix = catalogue.indexed(spark, data)
    p = plan(ix.bm25("loading", 5))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (?:IN|INSET|= )", p) and re.search(r"PushedFilters: \[.*(?:EqualTo|In)\(stem,", p)
    assert "chunk_text" not in p and "Cartesian" not in p and "NestedLoop" not in p
    names = ["load", "é", "", "日本", "x" * 50]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(bucket_of("n")).collect()
    assert [r[0] for r in rows] == [bucket_number(n) for n in names]


def test_cells_prune_and_texts_come_last(spark, data):
    from siltstone.plans import catalogue

    ix = catalogue.indexed(spark, data)
    p = plan(ix.knn([1.0] * 64, 5, exact=False))
    assert re.search(r"PartitionFilters: \[.*part#\d+", p) and re.search(r"PushedFilters: \[.*In\(cell,", p)
    assert "StringStartsWith(file_path,src/)" in plan(ix.knn([1.0] * 64, 5, "src/"))
    assert "dynamicpruning" in plan(ix.fetch(ix.knn([1.0] * 64, 5), "chunk_text")).lower()
