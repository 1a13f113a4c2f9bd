import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import split
from siltstone.llm.dedupe import one_row_per_id

TEXT = st.text(alphabet=st.sampled_from("ab .\n\r#。é😀"), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(3, 60), st.integers(0, 3))
def test_pieces(text, limit, overlap):
    spans = split.split_spans(text, limit, overlap)
    assert all(b - a <= limit for a, _, b in spans)
    assert "".join(text[n:b] for _, n, b in spans) == text
    for (a0, _, b0), (a, new, b) in zip(spans, spans[1:]):
        assert a0 < a <= new == b0 < b
        assert text.count("\n", a, new) <= overlap


def test_natural_places():
    para = "One sentence here. Another one there.\n" * 5
    text = (para + "\n") * 4
    for a, new, b in split.split_spans(text, 260, 2)[:-1]:
        assert text[b - 1] == "\n"
    words = "word " * 100
    assert {words[b - 1] for _, _, b in split.split_spans(words, 52, 2)[:-1]} == {" "}
    assert split.split_spans("x" * 100, 32) == [(0, 0, 32), (30, 32, 62), (60, 62, 92), (90, 92, 100)]


@pytest.mark.parametrize("text", ["word and more " * 600, "x" * 9000, "short\n" * 40 + "long line of words " * 400 + "\n" + "short\n" * 400, "a, b; " * 2000, "一二三。" * 3000])
def test_every_piece_repeats_something(text):
    spans = split.split_spans(text)
    assert len(spans) > 1 and all(a < n for a, n, _ in spans[1:])
    assert all(b - a <= 1536 for a, _, b in spans) and "".join(text[n:b] for _, n, b in spans) == text


def test_a_cut_line_counts_as_one_of_the_two():
    text = "\n".join(["a" * 100, "b" * 100, "word " * 500])
    a, new, _ = split.split_spans(text, 300, 2)[1]
    assert text[a:new] and len(text[a:new]) <= 150


def test_overlap_is_two_lines():
    text = "\n".join(f"line {i:03d} of the text" for i in range(100))
    spans = split.split_spans(text, 300, 2)
    assert all(text[a:n].count("\n") == 2 for a, n, _ in spans[1:])


def test_table(spark):
    big = "\r\n".join(f"line {i}" for i in range(600))
    rows = [(1, big, 10, "x"), (1, big, 10, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, "a" * 1536, 0, "x"), (5, "😀" * 1537, None, "x"), (None, big, 0, "x")]
    df = spark.createDataFrame(rows, "id long, chunk_text string, start_line int, piece_index string")
    got = split.split_oversized(df).orderBy("id", "piece_index").collect()
    assert {r["id"] for r in got} == {1, 5}
    one = [r for r in got if r["id"] == 1]
    lines = big.split("\n")
    assert [r["piece_index"] for r in one] == list(range(len(one))) and one[0]["start_line"] == 10 and one[-1]["end_line"] == 609
    for r in one:
        assert len(r["piece_text"]) <= 1536
        assert [x.rstrip("\r") for x in r["piece_text"].split("\n")] == [x.rstrip("\r") for x in lines[r["start_line"] - 10 : r["end_line"] - 9]]
    assert all(b["start_line"] == a["end_line"] - 1 for a, b in zip(one, one[1:]))
    assert [r["start_line"] for r in got if r["id"] == 5] == [None, None]
    assert split.split_oversized(df.limit(0)).count() == 0


def test_running_sums_over_blocks(spark):
    rows = [("hot", i * 3, i, 1 + i % 3) for i in range(700)] + [("a", 0, 1, 4), ("a", 0, 2, 1), (None, 5, 3, 2)]
    df = spark.createDataFrame(rows, "f string, ci int, id long, n int")
    got = {(r["f"], r["id"]): r["k"] for r in split.running_start(df, ["f"], ["ci", "id"], "ci", "n", "k", width=64).collect()}
    at = 0
    for i in range(700):
        assert got["hot", i] == at
        at += 1 + i % 3
    assert (got["a", 1], got["a", 2], got[None, 3]) == (0, 4, 0)


def test_pieces_of_the_table(spark, data):
    """What holds for the pieces of all chunks: limit, order, lines, overlap, and that they join to the texts."""
    from siltstone.llm import catalogue

    texts = {r["id"]: r for r in one_row_per_id(spark.read.parquet(f"{data}/chunks.parquet").drop("embedding")).collect()}
    rows = catalogue.queries()["p4_pieces"](spark, data).collect()
    assert {r["id"] for r in rows} == set(texts)
    versions = {}
    for r in rows:
        versions.setdefault((r["file_path"], r["file_hash"]), []).append((r["chunk_index"], r["old_index"], r["id"], r["piece_index"]))
    for v in versions.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and [x[1:] for x in v] == sorted(x[1:] for x in v)
    pieces = {}
    for r in split.split_oversized(spark.read.parquet(f"{data}/chunks.parquet")).collect():
        pieces.setdefault(r["id"], []).append(r)
    assert set(pieces) == {i for i, r in texts.items() if r["chunk_text"] and len(r["chunk_text"]) > 1536}
    for i, ps in pieces.items():
        text, lines = texts[i]["chunk_text"], texts[i]["chunk_text"].split("\n")
        ps.sort(key=lambda p: p["piece_index"])
        assert "".join(text[p["new_char"] : p["end_char"]] for p in ps) == text and all(p["start_char"] < p["new_char"] for p in ps[1:])
        for p in ps:
            assert len(p["piece_text"]) <= 1536
            first, last = p["start_line"] - texts[i]["start_line"], p["end_line"] - texts[i]["start_line"]
            shown = p["piece_text"].split("\n")
            assert len(shown) == last - first + 1 and all(a.rstrip("\r") in b for a, b in zip(shown, lines[first : last + 1]))


def test_rechunk(spark):
    big = "word " * 800
    rows = [(1, "f", "h", 0, "small", 0, 0), (2, "f", "h", 1, big, 1, 1), (3, "f", "h", 2, None, 2, 2), (4, "f", None, 0, "x", 0, 0), (1, "f", "h", 0, "small", 0, 0)]
    df = spark.createDataFrame(rows, "id long, file_path string, file_hash string, chunk_index int, chunk_text string, start_line int, end_line int")
    got = split.rechunk(df).orderBy("file_hash", "chunk_index").collect()
    assert [r["chunk_index"] for r in got] == [0, *range(len(got) - 1)]
    assert all(r["chunk_text"] is None or len(r["chunk_text"]) <= 1536 for r in got)


def test_one_row_per_id(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "2026-01-01"), (None, "c", None), (2, None, None)], "id long, _r string, updated_at string")
    got = {r["id"]: r["_r"] for r in one_row_per_id(df.withColumn("updated_at", df.updated_at.cast("timestamp"))).collect()}
    assert got == {1: "b", 2: None}
