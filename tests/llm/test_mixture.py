import pytest

from siltstone.llm import mixture as mx

DOCS = [(i, "word " * (20 + i % 7) , "  Big " if i % 2 else "big", "x") for i in range(400)] + [(1000 + i, "tiny text number %d" % i, "Small", "x") for i in range(12)] + [(2000, None, "big", "x"), (2001, "", "small", "x"), (2002, "lost", None, "x"), (2003, "other", "untargeted", "x")]
TARGETS = [("big", 30.0, 2), ("small", 10.0, 3), ("gone", 60.0, 1), ("BIG", 1.0, 1), (None, 5.0, 1)]


def tables(spark, docs=DOCS, targets=TARGETS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, part string"), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")


def check(mixture, shares, docs, cap):
    rows = mixture.collect()
    used = {}
    for r in rows:
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + r["part"]
    sizes = {r["doc_id"]: r["tokens"] for r in mx.with_tokens(docs).collect()}
    for d, n in used.items():
        assert n <= sizes[d] * cap[next(r["source"] for r in rows if r["doc_id"] == d)]
    by = {r["source"]: r for r in shares.collect()}
    assert sum(r["tokens"] for r in by.values()) == sum(r["part"] for r in rows)
    return by, rows


def test_largest_mixture(spark):
    d, t = tables(spark)
    mixture, shares = mx.mix(d, t, block_tokens=16)
    by, rows = check(mixture, shares, d, {"big": 2, "small": 3})
    assert by["gone"]["tokens"] == 0 and by["gone"]["target_share"] == 0
    assert by["big"]["actual_share"] == pytest.approx(0.75, abs=0.06) and by["small"]["actual_share"] == pytest.approx(0.25, abs=0.06)
    assert by["small"]["repeats"] == 3
    blocks = {}
    for r in rows:
        blocks[r["slot"]] = blocks.get(r["slot"], 0) + r["part"]
    assert set(blocks.values()) == {16}  # every block is whole
    again = mx.mix(d, t, block_tokens=16)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_every_prefix_is_near_the_weights(spark):
    order = [dict(source=s, take=w * 1000, tokens=10**6, most=10**6, r=1, docs=10, target_share=w) for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))]
    slots = [r["source"] for r in mx.schedule(spark, order, 1).orderBy("slot").collect()]
    assert len(slots) == 1000
    for n in range(10, 1001, 10):
        for r in order:
            assert abs(slots[:n].count(r["source"]) - n * r["target_share"]) <= 6


def test_given_size_fills_the_others(spark):
    d, t = tables(spark)
    rows = {r["source"]: r for r in mx.plan(mx.with_tokens(d), t, total_tokens=5000)}
    assert rows["small"]["take"] == rows["small"]["most"] and rows["big"]["take"] == pytest.approx(5000 - rows["small"]["most"])
    assert {r["source"]: r["take"] for r in mx.plan(mx.with_tokens(d), t, total_tokens=10**9)}["big"] == rows["big"]["most"]


def test_empty(spark):
    d, t = tables(spark)
    for a, b in ((d.limit(0), t), (d, t.limit(0)), (d.where("source is null"), t)):
        mixture, shares = mx.mix(a, b)
        assert mixture.count() == 0 and all(r["tokens"] == 0 for r in shares.collect())


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "a" * 250_000, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in mx.with_tokens(d).collect()}
    assert got[2] == 0 and 0 < got[1] <= 4 and got[3] > 1000


def test_long_texts_are_counted_whole(spark):
    import os

    text = "ab cd, " * 20_000 + "xy" * 120_000
    got = mx.with_tokens(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()["tokens"]
    assert got == len(mx.encoder(os.path.join(mx.TOKENIZER_FOLDER, mx.VOCABULARY)).encode_ordinary(text))


def test_shares_of_the_tables(spark):
    from siltstone.llm import catalogue

    by = {r["source"]: r for r in catalogue.queries()["p8_shares"](spark, "/root/testdata/sf0.01").collect()}
    assert all(abs(r["target_share"] - r["actual_share"]) < 0.003 and r["repeats"] <= r["max_repeats"] for r in by.values())
    full = {r["source"]: r for r in catalogue.queries()["p8_filled_shares"](spark, "/root/testdata/sf0.01").collect()}
    live = [r for r in full.values() if r["target_share"] > 0]
    assert sum(r["tokens"] for r in live) == pytest.approx(sum(r["available"] for r in live), rel=0.01)
    for r in live:
        assert r["tokens"] <= r["available"] * r["max_repeats"] and (r["capped"] or r["actual_share"] >= r["target_share"] - 0.003)
        if r["capped"]:
            assert r["tokens"] >= 0.95 * r["available"] * r["max_repeats"]
