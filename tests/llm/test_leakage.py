import numpy as np
import pytest

from siltstone.llm import leakage as lk

PASSAGE = "One router beside the batch rebuilds no broken pool on the local side and then one posting beside the bucket must outlive every remote token in Klolo at depth 49. Every nested scheduler never reads that window before 47 writers wake while the ledger keeps every stale lease for later runs."
ZH = "等kulal关闭之后损坏的缓存里的tustel重新清点缓慢的批次里的lazus并且等stistas关闭之后旧的片段里的fedos推迟旁边那个日志在深度85处损坏的账本里的malix推迟旧的账本里的glatrar直到第65次信号旁边那个窗口推迟旁边那个片段"
ITEMS = [(1, "en", PASSAGE), (2, "zh", ZH), (3, "en", None), (4, None, ""), (5, "en", "short item of five words"), (1, "en", PASSAGE)]
W = PASSAGE.split()
HALF = " ".join(W[5:30])


def found(text):
    by_word, by_char = lk.make_items([i for i in ITEMS if i[2]])
    t = lk.normal(text)
    out = {by_word.ids[i] for _, i in lk.leaks([lk._numbers(lk.words(t), {})], by_word)}
    return out | {by_char.ids[i] for _, i in lk.leaks([lk._numbers(lk.chars(t), {})], by_char)}


CASES = [
    HALF, HALF.upper(), "\n> ".join(HALF.split()), "```\n// " + HALF.replace(" the ", " the\n// ") + "\n```", HALF.replace(" the ", " <em>the</em> ").replace("broken", "**broken**"),
    "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in HALF), HALF.replace("o", "о").replace("e", "е"), "​".join(HALF), HALF.replace("broken", "busted").replace("bucket", "pail"),
    " ".join(W[5:16] + "quite by the way".split() + W[16:30]), '{"t": "' + HALF.replace("e", "\\u0065") + '"}', "bla " * 3000 + HALF + " bla" * 3000, HALF.replace("posting", "post-\ning"),
]


@pytest.mark.parametrize("text", CASES)
def test_leaks(text):
    assert found("Some words before. " + text + " And some after it.") == {1}


def test_chinese():
    assert found("前面的话。" + ZH[20:80].replace("缓存", "缓,存") + "后面") == {2}
    assert found(ZH[20:40]) == set()


@pytest.mark.parametrize("text", [" ".join(W[:14]), " ".join(reversed(W)), " ".join(sorted(W)), " x y z ".join(W), "", "   ", "the the the the the the the the the the the the", " ".join(W[:9]) + " far " * 300 + " ".join(W[40:49])])
def test_no_leaks(text):
    assert found(text) == set()


def test_short_item():
    assert 5 in found("it holds short item of five words and then goes on for a good while after that")


def test_against_alignment_everywhere(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["text"]]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", "lang", "passage").collect()]
    by_word, by_char = lk.make_items(items)
    want = set()
    for d, t in docs:
        n = lk.normal(t)
        for kind, cut in ((by_word, lk.words), (by_char, lk.chars)):
            s = lk._numbers(cut(n), {})
            for i, x in enumerate(kind.symbols):
                need = lk.PART * len(x)
                if np.isin(x, s).sum() >= lk.LEAST_EQUAL * need:
                    covered, equal = lk.align(x, s)
                    if covered >= need and equal >= lk.LEAST_EQUAL * covered:
                        want.add((d, kind.ids[i]))
    got = {tuple(r) for r in lk.find_leaks(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_table(spark):
    d = spark.createDataFrame([(1, HALF, "x"), (1, HALF, "x"), (2, None, "x"), (3, " ", "x"), (None, HALF, "x")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(ITEMS, "item_id long, lang string, passage string")
    assert [tuple(r) for r in lk.find_leaks(d, i).collect()] == [(1, 1)]
    assert lk.find_leaks(d.limit(0), i).count() == 0 == lk.find_leaks(d, i.limit(0)).count()


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lk, "ITEM_BLOCK", 2)
    d = spark.createDataFrame([(1, HALF)], "doc_id long, text string")
    assert lk.find_leaks(d, spark.createDataFrame(ITEMS, "item_id long, lang string, passage string")).count() == 1


def test_walks_keep_step():
    w = lk.Walks(lk.WORDS)
    a = np.arange(1, 60, dtype=np.int64) * 7919
    b = np.insert(a, 30, 5)
    same = sum(bool(set(w.keys(a, r)) & set(w.keys(b, r)[25:40])) for r in range(w.kind.repeats))
    assert same == w.kind.repeats


def numbered(rng, n):
    return rng.integers(1, 2**31, n)


def test_fifth_words_changed_alone_and_in_blocks():
    rng = np.random.default_rng(5)
    items = lk.Items(lk.WORDS, list(range(40)), [numbered(rng, int(n)) for n in rng.integers(40, 90, 40)]).build()
    docs, want = [], set()
    for i, x in enumerate(items.symbols * 5):
        n = -(-2 * len(x) // 5)
        start = int(rng.integers(0, len(x) - n + 1))
        leak = x[start : start + n].copy()
        leak[2 : n - 1 : 5] = numbered(rng, len(leak[2 : n - 1 : 5]))
        docs.append(np.concatenate([numbered(rng, 100), leak, numbered(rng, 100)]))
        covered, equal = lk.align(x, docs[-1])
        if covered >= lk.PART * len(x) and equal >= lk.LEAST_EQUAL * covered and equal >= lk.LEAST_EQUAL * lk.PART * len(x):
            want.add((i, i % 40))
    alone = {(o, i) for o, d in enumerate(docs) for _, i in lk.leaks([d], items)}
    assert len(want) > 100 and alone >= want
    assert set(lk.leaks(docs, items)) == alone == {(s + o, i) for s in range(0, 200, 7) for o, i in lk.leaks(docs[s : s + 7], items)}


@pytest.mark.parametrize("first", [31, 35, 38])
def test_tail_at_the_start_of_a_later_document(first):
    rng = np.random.default_rng(6)
    item = numbered(rng, 64)
    items = lk.Items(lk.WORDS, [1], [item]).build()
    other, leak = numbered(rng, 300), np.concatenate([item[first:], numbered(rng, 200)])
    assert lk.leaks([leak], items) == [(0, 0)]
    assert lk.leaks([other, leak, other], items) == [(1, 0)]
