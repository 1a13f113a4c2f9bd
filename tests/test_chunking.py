import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.operators import chunking

CODE = """function one(a) {
  return a;
}

class Two {
  run() {
    return 2;
  }

  stop() {}
}
const x = 1;
// note
async function three() {}"""


@pytest.mark.parametrize("line,kind", [("if (x) {", "function"), ("  getValue() {", "function"), ("} else if (x) {", None), ("class A {", "class"), ("interface B {", "interface"), ("type C = 1", "other"), ("import x", "import"), ("// c", "comment")])
def test_js_lines(line, kind):
    assert chunking.line_kind_of(line, "ts") == kind


@pytest.mark.parametrize("end,line,kind", [("py", "  async def f(x):", "function"), ("py", "class A:", "class"), ("go", "func (s *S) Do(x int) {", "function"), ("rs", "pub fn f<T>(", "function"), ("rs", "impl Foo {", "class"), ("java", "public static int f(int a) {", "function"), ("rb", "def self.x?", "function"), ("txt", "function f() {", None)])
def test_other_lines(end, line, kind):
    assert chunking.line_kind_of(line, end) == kind


def test_units():
    parts = chunking.chunk_file(CODE, "a.ts")
    assert [(s, e) for _, s, e in parts] == [(0, 3), (4, 4), (5, 8), (9, 12), (13, 13)]
    assert "\n".join(t for t, _, _ in parts) == CODE


def test_context_limit_cuts():
    got = chunking.chunk_file("x" * 1000, "a.txt", 100, 10, 200)
    assert all(len(t) <= 300 for t, _, _ in got) and len(got) == 1


def test_empty_and_blank():
    assert chunking.chunk_file("", "a.ts") == [] == chunking.chunk_file(None, None) == chunking.chunk_file("\n \n", "a.ts")


def test_overlap_lines():
    lines = [f"line number {i}" for i in range(12)]
    got = chunking.chunk_lines(lines, 15, 40, 1000)
    assert got[0][1] == 0 and got[1][1] == got[0][2] - 1  # two lines again
    assert chunking.chunk_lines(lines, 15, 0, 1000)[1][1] == chunking.chunk_lines(lines, 15, 0, 1000)[0][2] + 1


@given(st.lists(st.text(alphabet="ab ", max_size=20), max_size=30), st.integers(1, 20), st.integers(0, 60))
def test_every_line_is_there(lines, tokens, overlap):
    got = chunking.chunk_lines(lines, tokens, overlap, 10**6)
    covered = {i for _, s, e in got for i in range(s, e + 1)}
    assert {i for i, x in enumerate(lines) if x.strip()} <= covered
    assert all(t == "\n".join(lines[s : e + 1]) for t, s, e in got)


def test_plan_agrees_with_python(spark):
    df = spark.createDataFrame([(1, "a.ts", CODE), (2, "b.py", "x = 1\ndef f(a):\n  pass\ndef g(b):\n  pass"), (3, "c.ts", None), (4, "d.ts", "")], "id long, path string, body string")
    got = {(r["id"], r["start_line"], r["end_line"]) for r in chunking.segments(df, "id", "path", "body").collect()}
    want = {(i, s, e) for i, p, b in df.collect() for _, s, e in chunking.chunk_file(b, p)}
    assert got == want
    whole = chunking.chunk_files(df, "id", "path", "body").collect()
    assert {(r["id"], r["start_line"], r["end_line"]) for r in whole} == want


def test_invalid(spark):
    df = spark.createDataFrame([(1, -1, 2, "a"), (2, 3, 2, "a"), (3, 0, 0, " "), (4, 0, 0, None), (5, 0, 1, "a")], "id long, start_line int, end_line int, chunk_text string")
    assert {(r["id"], r["problem"]) for r in chunking.invalid_chunks(df).collect()} == {(1, "negative start"), (2, "end before start"), (3, "blank text"), (4, "blank text")}
