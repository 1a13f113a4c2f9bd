import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import neighbours as nb


def table(spark, vectors, start=1):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, "clash") for i, v in enumerate(vectors, start)], "id long, embedding array<float>, rep string")


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.clip(x @ x.T, -1, 1), 6)
    return {int(i): [(int(ids[j]), s[r, j]) for j in sorted((j for j in range(len(ids)) if j != r), key=lambda j: (-s[r, j], ids[j]))[:k]] for r, i in enumerate(ids)}


def lists(df):
    out = {}
    for r in df.orderBy("id_a", "rank").collect():
        out.setdefault(r["id_a"], []).append((r["id_b"], r["cosine"]))
    return out


def test_recall_against_brute_force(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")
    rows = {}
    for r in c.select("id", "embedding").collect():
        if r["embedding"] is not None and len(r["embedding"]) == 64 and not np.isnan(r["embedding"]).any() and any(r["embedding"]):
            rows[r["id"]] = np.array(r["embedding"])
    ids = np.array(sorted(rows))
    want = brute(ids, np.array([rows[i] for i in ids]), 10)
    got = lists(nb.nearest_neighbours(c, k=10, probes=12))
    assert set(got) == set(want)
    hit = sum(len({b for b, _ in got[i]} & {b for b, _ in want[i]}) for i in want)
    assert hit / (10 * len(want)) >= 0.9


def test_exact_with_all_cells(spark):
    x = np.random.default_rng(0).normal(size=(300, 64))
    got = lists(nb.nearest_neighbours(table(spark, x), k=5, probes=10_000))
    want = brute(np.arange(1, 301), x.astype(np.float32).astype(np.float64), 5)
    same = sum([b for b, _ in got[i]] == [b for b, _ in want[i]] for i in want)
    assert same >= 295  # four-bit candidates, reranked exactly


def test_group_of_copies(spark):
    rng = np.random.default_rng(1)
    one, near = rng.normal(size=64), rng.normal(size=(20, 64))
    x = [one * (1 + i % 3) for i in range(150)] + list(near) + [one + 0.01]
    got = lists(nb.nearest_neighbours(table(spark, x), k=10, probes=100, min_cosine=0.9))
    assert [b for b, _ in got[1]] == list(range(2, 12)) and [b for b, _ in got[7]] == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert [b for b, _ in got[140]] == list(range(1, 11)) and 171 in got and len(got[171]) == 10
    pairs = {(r["id_a"], r["id_b"]) for r in nb.mutual_pairs(nb.nearest_neighbours(table(spark, x), k=10, probes=100, min_cosine=0.9)).collect()}
    assert pairs == {(a, b) for a in range(1, 12) for b in range(a + 1, 12)}


def test_unusable_and_repeated(spark):
    good = np.eye(64)[0]
    rows = table(spark, [good, good, None, np.zeros(64), [1.0] * 32, [float("nan")] * 64, np.eye(64)[1]])
    rows = rows.union(rows).union(spark.createDataFrame([(None, [1.0] * 64, "x")], rows.schema))
    got = lists(nb.nearest_neighbours(rows, k=3, probes=8))
    assert set(got) == {1, 2, 7} and [b for b, _ in got[1]] == [2, 7]
    assert nb.nearest_neighbours(rows.limit(0), k=3).count() == 0
    assert nb.nearest_neighbours(rows.where("id = 1"), k=3).count() == 0


def test_queries_only(spark):
    x = np.random.default_rng(2).normal(size=(50, 64))
    got = lists(nb.nearest_neighbours(table(spark, x), k=3, probes=64, queries=F.col("id") % 10 == 0))
    assert set(got) == {10, 20, 30, 40, 50}


def test_score_aware_codes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = nb.fit(x, 8)
    cell = nb.nearest(x, index.centres, 1)[0][:, 0]
    res = x - index.centres[cell]
    weight = 4.0
    loss = lambda code: float(((e := res - index.decode(nb.pack(code))) ** 2).sum() + (weight - 1) * ((e * x).sum(1) ** 2).sum())
    plain, aware = nb.encode_words(res, x, index.books, 1.0), nb.encode_words(res, x, index.books, weight)
    assert loss(aware) < loss(plain)
    assert nb.pack(plain).shape == (2000, 4) and nb.pack(plain).dtype == np.uint8
    assert nb.eta(64, 0.2) == pytest.approx(63 * 0.04 / 0.96)


def test_a_dense_cluster_gives_no_more_than_its_lists():
    rng = np.random.default_rng(2)
    x = (np.eye(1, 64) + rng.normal(size=(3000, 64)) * 0.03).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = nb.fit(x, 4)
    cell = nb.nearest(x, index.centres, 1)[0][:, 0]
    codes = nb.pack(nb.encode_words(x - index.centres[cell], x, index.books, nb.eta()))
    for c in range(4):
        mine = np.flatnonzero(cell == c)
        a, b, score = nb.scan_block(index, c, x, codes[mine], x[mine], 10, 0.9, True, (np.arange(len(x)), mine))
        assert len(a) <= 11 * (len(x) + len(mine))
        exact = np.round(x.astype(np.float64) @ x[mine].astype(np.float64).T, 6)
        q = int(rng.integers(len(x)))
        want = np.lexsort((mine, -exact[q]))[:11]
        assert set(want) <= set(b[a == q])
        v = int(rng.integers(len(mine)))
        assert set(np.lexsort((np.arange(len(x)), -exact[:, v]))[:11]) <= set(a[b == v])


def test_recall_of_the_tables(spark):
    """Default cells at sf0.1: ten nearest of every chunk whose id is divisible by 100."""
    from siltstone.llm import catalogue

    sf = "/root/testdata/sf0.1"
    got = {}
    for r in catalogue.queries()["p6_neighbours"](spark, sf).collect():
        got.setdefault(r["id_a"], set()).add(r["id_b"])
    rows = {r["id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/chunks.parquet").where(nb.usable(F.col("embedding")) & F.col("id").isNotNull()).select("id", "embedding").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids.tolist()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = all_ = 0
    for i in ids[ids % 100 == 0].tolist():
        s = np.round(x @ x[np.searchsorted(ids, i)], 6)
        s[np.searchsorted(ids, i)] = -9
        best = set(ids[np.lexsort((ids, -s))[:10]].tolist())
        hit, all_ = hit + len(best & got[i]), all_ + 10
    assert all_ > 1000 and hit >= 0.9 * all_
    print("recall", hit / all_)
