import math
from collections import Counter

from siltstone.llm import distinctive as di

ROWS = [(1, "alpha beta beta common", "Gamma_x", "t"), (2, "common common delta", None, "t"), (3, None, "", "t"), (1, "alpha beta beta common", "Gamma_x", "t"), (4, "", None, "t"), (None, "alpha", None, "t"), (5, "common", "", "t")]
SCHEMA = "id long, chunk_text string, identifiers string, term string"


def brute(docs, strength):
    tf = {i: Counter(w) for i, w in docs.items()}
    total = sum(tf.values(), Counter())
    size = sum(total.values())
    out = {}
    for i, c in tf.items():
        n = sum(c.values())
        for w, y in c.items():
            a, rest = strength * total[w] / size, total[w] - y
            d = math.log((y + a) / (n + strength - y - a)) - math.log((rest + a) / (size - n + strength - rest - a))
            out[i, w] = round(d / math.sqrt(1 / (y + a) + 1 / (rest + a)), 6)
    return out


def test_scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = brute({1: "alpha beta beta common gamma_x".split(), 2: "common common delta".split(), 5: ["common"]}, 500.0)
    got = {(r["id"], r["term"]): r["z"] for r in di.term_scores(df).collect()}
    assert got == want
    assert got[1, "beta"] > got[1, "alpha"] > got[1, "common"]
    assert di.term_scores(df.limit(0)).count() == 0


def test_top_and_ties(spark):
    df = spark.createDataFrame([(1, "b a", None, "t"), (2, "c c", None, "t")], SCHEMA)
    got = [(r["id"], r["term"], r["rank"]) for r in di.distinctive_terms(df, 1).orderBy("id").collect()]
    assert got == [(1, "a", 1), (2, "c", 1)]


def test_one_record_and_one_term(spark):
    got = di.term_scores(spark.createDataFrame([(1, "x x x", None, "t")], SCHEMA)).collect()
    assert [(r["term"], r["tf"]) for r in got] == [("x", 3)]


def test_same_as_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW chunks AS SELECT * FROM read_parquet('{data}/chunks.parquet')")
    want = sorted(con.sql(f"SELECT id, term, tf, z FROM ({di.SQL['p2_scores']})").fetchall())
    got = sorted((r["id"], r["term"], r["tf"], r["z"]) for r in di.p2_scores(spark, data).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))
