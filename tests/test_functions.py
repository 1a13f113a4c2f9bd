import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import fixed, globs, scalar, text, tokenizers
from siltstone.operators import embed


def one(spark, col, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names or "x string").select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("s,h", [("", 5381), ("a", 177604), ("abc", 193409669), ("hello world", 4173747013), ("test string", 4234766726), (None, None)])
def test_djb2a(spark, s, h):
    assert one(spark, scalar.djb2a(F.col("s")), s=s) == h


@pytest.mark.parametrize("s,h", [("", "84222325811c9dc5"), ("a", "26bd533fe40c292c"), ("b", "26bd533fe70c2de5"), ("abc", "1dd12ad71a47e90b"), ("€", "26bd531fa93e2c4b"), (None, None)])
def test_file_hash(spark, s, h):
    assert one(spark, scalar.file_hash(F.col("s")), s=s) == h


def test_split_camel(spark):
    assert one(spark, text.split_camel(F.col("s")), s="getHTTPServerById") == ["get", "HTTP", "Server", "By", "Id"]
    assert text.camel_parts("getHTTPServerById") == ["get", "HTTP", "Server", "By", "Id"]


def test_identifier_variants():
    assert text.identifier_variants(["get", "user", "by", "id"]) == ["get user id", "getUserId", "get_user_id", "getUser", "userId"]
    assert text.identifier_variants(["one"]) == []


@pytest.mark.parametrize("n,tokens", [(0, 0), (1, 1), (3, 1), (4, 2)])
def test_estimate_tokens(spark, n, tokens):
    assert one(spark, scalar.estimate_tokens(F.col("s")), s="x" * n) == tokens


def test_fts_tokens(spark):
    assert one(spark, text.fts_tokens(F.col("s")), s="Foo_bar-Baz é1") == ["foo", "bar", "baz"]


@pytest.mark.parametrize("p,w", [("a.ts", 1.2), ("a.py", 1.1), ("a.md", 0.8), ("a.txt", 0.7), ("Makefile", 1.0)])
def test_file_type_multiplier(spark, p, w):
    assert one(spark, scalar.file_type_multiplier(F.col("s")), s=p) == w


def test_identifier_boost_and_rrf(spark):
    assert [one(spark, scalar.identifier_boost(F.lit(n)), s="x") for n in (0, 1, 2)] == [1.0, 1.5, 2.0]
    assert one(spark, scalar.rrf([F.lit(1), F.lit(1)]), s="x") == pytest.approx(2 / 61)


@pytest.mark.parametrize("q,want", [("a", ""), ("foo", "foo*"), ("foo bar", "foo* AND bar*"), ("aa bb cc dd ee ff gg", "aa* OR bb* OR cc* OR dd* OR ee* OR ff* OR gg*")])
def test_prefix_query(q, want):
    assert text.prefix_query(q) == want


def test_query_phrases():
    got = text.query_phrases('find "db" getUserById')
    assert got[:6] == ["find", "db", "database", "sql", "query", "storage"]
    assert "get user id" in got and len(got) <= 20
    assert text.query_phrases('"()*') == []


GLOBS = [
    ("src/components/Button.tsx", ["**/*.tsx"], [], True), ("src/components/Button.test.tsx", ["**/*.tsx"], ["**/*.test.*"], False),
    ("src/utils/helpers.js", ["**/*.ts"], [], False), ("dist/bundle.js", ["**/*.ts", "**/*.js"], ["dist/**"], False),
    ("node_modules/lib/index.js", ["**/*.js"], ["node_modules/**"], False), ("src/test.spec.ts", ["**/*.ts"], ["**/*.spec.*"], False),
    ("src/Dockerfile", ["**/*.ts", "**/*.js"], [], False), (".env.local", ["**/*"], ["**/.env*"], False), (".eslintrc.js", ["**/*.js"], [], True),
    (".config/config.json", ["**/*.json"], ["**/.config/**"], False), ("a.ts", [], [], False), ("a/b.ts", ["*.ts"], [], False), ("ab.ts", ["?b.{ts,js}"], [], True), ("x1.c", ["x[0-9].c"], [], True),
]


@pytest.mark.parametrize("path,inc,exc,want", GLOBS)
def test_globs(spark, path, inc, exc, want):
    assert one(spark, globs.should_index(F.col("s"), inc, exc), s=path) is want


def test_glob_validation_and_files():
    globs.validate(["**/*.ts", "src/**"])
    with pytest.raises(ValueError):
        globs.validate(["invalid[ pattern"])
    assert globs.ignore_lines_to_globs(["# c", "", "dir/", "name", "a/b", "*.x"]) == ["dir/**", "**/name", "a/b", "*.x"]
    assert globs.blacklist_to_globs([".pem", "/secrets/", "a*b", " "]) == [".pem", "**/secrets/**", "a*b"]


def test_blacklist(spark):
    assert one(spark, globs.blacklisted(F.col("s")), s="a/node_modules/b.ts") is True
    assert one(spark, globs.blacklisted(F.col("s"), whitelist=["keep"]), s="a/node_modules/keep.ts") is False
    assert one(spark, globs.is_safe(F.col("s")), s="../a.ts") is False


def test_grep_and_deletes(spark):
    assert one(spark, text.is_code_grep(F.col("s")), s="grep -rn 'foo' src/a.ts") is True
    for bad in ("git grep 'x' a.ts", "cat a | grep 'x'", "grep 'x' a.ts > out"):
        assert one(spark, text.is_code_grep(F.col("s")), s=bad) is False
    assert one(spark, text.grep_pattern(F.col("s")), s='grep -r "foo bar" .') == "foo bar"
    assert one(spark, text.grep_pattern(F.col("s")), s="ls") is None
    assert one(spark, text.deleted_paths(F.col("s")), s="rm -rf a/b.ts c.ts && git mv d e") == ["a/b.ts", "c.ts", "git", "mv", "d", "e"]


def test_identifiers_agree(spark):
    code = "export const fooBar = 1\nfunction Baz(x) {}\nimport { q } from './mod'\nlet a: number"
    assert sorted(one(spark, text.extract_identifiers(F.col("s")), s=code)) == sorted(text.identifiers_of(code))
    assert "foobar" in text.identifiers_of(code) and "./mod" in text.identifiers_of(code)


def test_placeholder_agrees(spark):
    got = one(spark, scalar.placeholder_embedding(F.col("s"), 16), s="some text")
    assert got == pytest.approx(embed.placeholder_vector("some text", 16), abs=1e-6)


@pytest.mark.parametrize("w,s", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("sky", "sky"), ("relational", "relat"), ("controlling", "control"), ("été", "été"), ("", "")])
def test_porter(w, s):
    assert text.porter_stem(w) == s


def test_wordpiece_and_bpe():
    v = tokenizers.char_vocabulary(["index", "ing"])
    inv = {i: n for n, i in v.items()}
    assert [inv[i] for i in tokenizers.wordpieces("Indexing, é!", v)] == ["[CLS]", "index", "##ing", ",", "e", "!", "[SEP]"]
    assert [inv[i] for i in tokenizers.wordpieces("日 " + "a" * 101, v)] == ["[CLS]", "[UNK]", "[UNK]", "[SEP]"]
    ids, marks = tokenizers.pair_pieces("a", "b c", v)
    assert len(ids) == len(marks) == 6 and marks == [0, 0, 0, 1, 1, 1]
    assert tokenizers.merge_pairs("hello", {("l", "l"): 0, ("h", "e"): 1, ("he", "ll"): 2}) == ["hell", "o"]


def test_tables_have_no_doubles():
    assert len(set(fixed.EXCLUDE_GLOBS)) == len(fixed.EXCLUDE_GLOBS) and len(set(fixed.KEYWORDS)) == len(fixed.KEYWORDS)


@given(st.text(max_size=30))
def test_placeholder_is_unit(s):
    v = embed.placeholder_vector(s, 8)
    assert sum(x * x for x in v) == pytest.approx(1, abs=1e-5)


def reference_vector(text, dim):
    """The formula written out: a Lehmer sequence from the hash of the UTF-16 units, 1 only in place of 0."""
    import struct

    h = 5381
    for (u,) in struct.iter_unpack(">H", text.encode("utf-16-be")):
        h = ((h * 33) ^ u) & 0xFFFFFFFF
    rng, out = h % 2147483647, []
    if rng == 0:
        rng = 1
    for _ in range(dim):
        rng = rng * 16807 % 2147483647
        out.append(struct.unpack("f", struct.pack("f", rng / 2147483647 * 2 - 1))[0])
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out]


def test_placeholder_vectors_are_the_formulas(spark):
    from siltstone.functions import scalar
    from siltstone.operators import embed

    texts = ["hello world", "test string", "abc", "", "a\U0001f600b", "é中"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["v"], r["h"]) for r in df.select(scalar.placeholder_embedding(F.col("t"), 5).alias("v"), scalar.djb2a(F.col("t")).alias("h")).collect()]
    for t, (v, _) in zip(texts, got):
        want = reference_vector(t, 5)
        assert max(abs(a - b) for a, b in zip(v, want)) < 1e-6 and max(abs(a - b) for a, b in zip(embed.placeholder_vector(t, 5), want)) < 1e-6
    assert got[0][1] == 4173747013 and got[0][1] % 2147483647 % 2 == 0  # an even seed stays even
    raw = [4173747013 % 2147483647 * pow(16807, i, 2147483647) % 2147483647 / 2147483647 * 2 - 1 for i in (1, 2)]
    assert abs(got[0][0][0] / got[0][0][1] - raw[0] / raw[1]) < 1e-5


def test_options_hash():
    from siltstone.functions.scalar import options_hash

    h = 0
    for c in "a1btrue":
        h = (h * 33 & 0xFFFFFFFF) ^ ord(c)
    assert options_hash({"b": True, "a": 1}) == options_hash({"a": 1, "b": True}) == h != options_hash({"a": 2, "b": True})


def test_expanding_columns_is_expanding_queries(spark):
    from siltstone.functions import text

    words = ["getUserById", "auth", "x", "HTTPServer", "load_index", "of_the"]
    got = {r["w"]: set(r["e"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.expand_columns(F.col("w")).alias("e")).collect()}
    assert got == {w: set(text.expand_query(w)) for w in words}
