import math

from pyspark.sql import functions as F

from siltstone.operators import embed, search
from siltstone.operators.index import SearchIndex

SCHEMA = "id long, file_path string, chunk_index int, chunk_text string, start_line int, end_line int, embedding array<float>, identifiers string, rank string, similarity string"
ROWS = [
    (1, "src/a.ts", 0, "function alpha() {\n  return beta;\n}", 0, 2, [1.0, 0.0], "alpha", "x", "y"),
    (2, "src/b.md", 0, "beta beta gamma", 0, 0, [0.9, 0.1], None, "x", "y"),
    (3, "lib/c.py", 0, None, 0, 0, None, "delta", None, None),
    (4, "lib/d.py", 0, "", 5, 5, [0.0, 0.0], "", None, None),
    (5, "lib/e.py", 0, "nothing here", 7, 7, [float("nan"), 1.0], "", None, None),
    (2, "src/b.md", 0, "beta beta gamma", 0, 0, [0.9, 0.1], None, "x", "y"),
    (6, None, None, "beta", None, None, [1.0, 0.0, 0.0], "", None, None),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def index(spark, tmp_path, rows=ROWS, dim=2):
    ix = SearchIndex(spark, str(tmp_path / f"ix{len(list(tmp_path.iterdir()))}"), dim)
    ix.write(table(spark, rows))
    return ix


def test_knn(spark):
    got = search.knn(table(spark), [1.0, 0.0], 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["similarity"] == 1.0
    assert search.knn(table(spark), [1.0, 0.0], 5, "lib/").count() == 0


def test_bm25(spark, tmp_path):
    ix = index(spark, tmp_path)
    got = {r["id"]: r["similarity"] for r in ix.bm25("beta", 5, stemmed=False).collect()}
    assert set(got) == {1, 2, 6}
    lengths = {1: 8, 2: 6, 3: 4, 4: 3, 5: 5, 6: 1}
    mean = sum(lengths.values()) / 6
    idf = max(math.log((6 - 3 + 0.5) / (3 + 0.5)), 1e-6)
    assert got[2] == round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * lengths[2] / mean)), 6)
    assert {r["id"] for r in ix.bm25("beta", 5, "src/").collect()} == {1, 2}
    assert ix.bm25("()", 5).count() == 0 and ix.bm25("zzz", 5).count() == 0
    assert index(spark, tmp_path, []).bm25("beta", 5).count() == 0


def rows_of(*texts):
    return [(i, f"f{i}.ts", 0, t, 0, 0, None, "", None, None) for i, t in enumerate(texts)]


def test_phrases_need_their_order_and_one_column(spark, tmp_path):
    ix = index(spark, tmp_path, rows_of("user get id", "get user id", "getUserId") + [(9, "x/get.ts", 0, "user here", 0, 0, None, "id", None, None)])
    got = {r["id"] for r in ix._phrases([["get", "user"]], 5, None, "term").collect()}
    assert got == {1}
    again = {r["id"]: r["similarity"] for r in index(spark, tmp_path, rows_of("a a a", "a b", "c", "d", "e", "f"))._phrases([["a", "a"]], 5, None, "term").collect()}
    assert set(again) == {0}


def test_stems(spark, tmp_path):
    ix = index(spark, tmp_path, rows_of("loading the cached values", "load a cache value", "lord of caching", "nothing"))
    assert {r["id"] for r in ix._phrases([["load"]], 5, None, "stem").collect()} == {0, 1}
    assert {r["id"] for r in ix.bm25("loads", 5).collect()} == {0, 1} and {r["id"] for r in ix.bm25("loads", 5, stemmed=False).collect()} == set()
    assert {r["id"] for r in ix.prefix_bm25("cach val", 5).collect()} == {0, 1}


def test_changes_of_the_index(spark, tmp_path):
    ix = index(spark, tmp_path, [(i, f"d{i % 3}/f{i % 6}.ts", i, f"word{i} shared", 0, 0, [1.0, i / 10], "", None, None) for i in range(30)])
    new = table(spark, [(100, "d1/f1.ts", 0, "fresh shared", 0, 0, [1.0, 0.05], "", None, None), (101, "new.ts", 0, None, 0, 0, None, None, None, None)])
    gone = spark.createDataFrame([("d2/f2.ts",), ("not/there.ts",)], "file_path string")
    before = ix.version()
    assert ix.change(new, gone) == before + 1
    assert {r["id"] for r in ix.read().collect()} == {i for i in range(30) if i % 6 not in (1, 2)} | {100, 101}
    same = SearchIndex(spark, ix.at.root + "x", 2)
    same.write(ix.read())
    assert (ix.state()["docs"], ix.state()["words"]) == (same.state()["docs"], same.state()["words"])
    lists = lambda x: ([(r["id"], r["similarity"]) for r in x.bm25("shared fresh word3", 40).collect()], [(r["id"], r["similarity"]) for r in x.knn([1.0, 0.1], 40).collect()])
    assert lists(ix) == lists(same)
    found = {r["id"]: r["chunk_text"] for r in search.keyword_search(ix, "fresh", 3).collect()}
    assert found == {100: "fresh shared"}
    ix.change(table(spark, [(100, "d1/f1.ts", 0, "again shared", 0, 0, [0.0, 1.0], "", None, None)]))  # the same id once more
    assert {r["id"]: r["chunk_text"] for r in ix.read().where("id = 100").collect()} == {100: "again shared"} and ix.knn([0.0, 1.0], 1).first()["id"] == 100
    ix.compact()
    assert len(ix.state()["segments"]) == 1 and ix.read().count() == 22 and ix.bm25("again", 3).first()["id"] == 100
    assert ix.stats() == {"version": 4, "segments": 1, "docs": 22, "words": ix.state()["words"], "cells": 4, "dim": 2}
    ix.vacuum(1)
    assert ix.knn([0.0, 1.0], 1, exact=False, probes=99).first()["id"] == 100
    ix.clear()
    assert ix.read().count() == 0 and ix.bm25("again", 3).count() == 0 == ix.knn([0.0, 1.0], 1).count()


def test_recall_of_cells(spark):
    """The default cells at sf0.01, for stored vectors and others."""
    from siltstone.plans import catalogue

    ix = catalogue.indexed(spark, "/root/testdata/sf0.01")
    asked = [r["embedding"] for r in ix.read().where("id % 400 = 0 AND size(embedding) = 64 AND NOT exists(embedding, x -> isnan(x)) AND exists(embedding, x -> x <> 0)").select("embedding").limit(8).collect()] + [embed.placeholder_vector(q, 64) for q in "ab"]
    hit = all_ = 0
    for v in asked:
        exact = {r["id"] for r in ix.knn(v, 10).collect()}
        hit, all_ = hit + len(exact & {r["id"] for r in ix.knn(v, 10, exact=False).collect()}), all_ + len(exact)
    assert hit >= 0.9 * all_


def test_literal(spark):
    df = table(spark, [(1, "a.ts", 0, "\n".join(["x"] * 5 + ["Hit"] + ["y"] * 5 + ["hit"]), 0, 11, None, "", None, None)])
    assert search.literal_search(df, "HIT").first()["preview"] == "x\nx\nHit\ny\ny\n...\ny\ny\nhit"
    assert search.literal_search(df, "100%").count() == 0
    assert search.literal_search(df, "hit", path_part="zzz").count() == 0


def test_hybrid_and_rerank(spark, tmp_path):
    ix = index(spark, tmp_path)
    got = search.hybrid_search(ix, "beta", [1.0, 0.0], 5, 0.0).orderBy("rank").collect()
    assert got[0]["similarity"] == 1.0 and all(0 <= r["similarity"] <= 1 for r in got)
    assert len({r["id"] for r in got}) == len(got)
    again = search.heuristic_rerank(search.hybrid_search(ix, "beta", [1.0, 0.0], 5, 0.0), "beta").collect()
    assert sorted(r["new_rank"] for r in again) == list(range(1, len(got) + 1))
    empty = index(spark, tmp_path, [])
    assert search.hybrid_search(empty, "beta", [1.0, 0.0], 5).count() == 0
    # no vector under the prefix: the keyword list with its own scores, whatever the threshold
    alone = search.hybrid_search(ix, "delta", [1.0, 0.0], 5, 0.99, "lib/").collect()
    assert [(r["id"], r["similarity"]) for r in alone] == [(r["id"], r["similarity"]) for r in ix.bm25("delta", 5, "lib/").collect()] != []


def test_fuse_keeps_the_worst_rank(spark):
    hits = spark.createDataFrame([(1, "a", 0, 1, None), (2, "a", 0, 2, None), (3, "a", 0, None, 1), (4, "z", 1, None, 2)], "id long, file_path string, start_line int, vector_rank int, word_rank int")
    got = {r["id"]: (r["vector_rank"], r["word_rank"]) for r in search.fuse(hits).collect()}
    assert got == {2: (2, 1), 4: (None, 2)}
    assert {r["id"] for r in search.fuse(hits.withColumn("vector_rank", F.lit(None).cast("int")).withColumn("word_rank", F.col("id").cast("int"))).collect()} == {1, 2, 3, 4}


def test_preview(spark):
    df = spark.createDataFrame([("\n  x\nexport class A {\n}",), ("class B {}\nx",), ("plain",), ("",), (None,)], "t string")
    got = [r["p"] for r in df.select(search.preview(F.col("t")).alias("p")).collect()]
    assert got == ["export class A {\n...\n\n  x\nexport class A {\n}", "class B {}\nx", "plain", "", None]


def test_embedding_failures(spark):
    def make():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError
            return [[float(len(t)), 0.0] for t in texts]

        return model

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("ccc",)], "t string")
    assert [r["vector"] for r in embed.embed(df, "t", make, dim=2).collect()] == [[1.0, 0.0], None, None, [3.0, 0.0]]
    http = embed.HttpEmbedder("http://x", "m", post=lambda u, b: {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, wait=lambda s: None)
    assert http(["a", "b"]) == [[1], [2]]
    assert embed.backoff_ms(0) == 1000 and embed.backoff_ms(10) == 30000
