"""Scalar functions as column expressions, all on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed

CHARS_PER_TOKEN = 3
U32 = 4294967295
FNV_PRIME = 16777619


def constant(value) -> Column:
    """A text, a number, a list or a dictionary of them as one expression, parsed at once instead of built part by part."""

    def sql(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, dict):
            return "map(" + ", ".join(f"{sql(k)}, {sql(x)}" for k, x in v.items()) + ")"
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(map(sql, v)) + ")" if len(v) else "cast(array() AS array<string>)"
        return repr(v)

    return F.expr(sql(value))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often and inside whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _code_points(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))


def _over_units(text: Column, start: int, step) -> Column:
    """``step`` over the UTF-16 units of a text: of a code point beyond the basic plane, its two halves one after the other."""
    high, low = lambda c: F.lit(0xD7C0) + F.shiftright(c, 10), lambda c: F.lit(0xDC00) + c.bitwiseAND(F.lit(0x3FF).cast("bigint"))
    return F.aggregate(_code_points(text), F.lit(start).cast("bigint"), lambda h, c: F.when(c > 65535, step(step(h, high(c)), low(c))).otherwise(step(h, c)))


def djb2a(text: Column) -> Column:
    """DJB2a of the UTF-16 units, 32 bits unsigned. Null gives null, the empty text 5381."""
    h = _over_units(text, 5381, lambda h, c: (h * F.lit(33)).bitwiseAND(F.lit(U32)).bitwiseXOR(c))
    return F.when(text == "", F.lit(5381).cast("bigint")).otherwise(h)


def file_hash(text: Column) -> Column:
    """Two FNV-like halves over the UTF-16 units as 16 hex digits. For parity; real change detection takes sha2."""
    one = _over_units(text, 0x811C9DC5, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32)))
    two = _over_units(text, 0x84222325, lambda h, c: (h * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32)).bitwiseXOR(F.shiftrightunsigned(c, 8)))
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")
    return F.when(text == "", F.lit("84222325811c9dc5")).otherwise(F.concat(digits(two), digits(one)))


def utf16_units(text: str) -> list[int]:
    """The UTF-16 units of a text, outside of a plan."""
    raw = text.encode("utf-16-be", "surrogatepass")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


def options_hash(options: dict) -> int:
    """A number for a set of options, whatever their order: DJB2a from 0 over sorted keys, each before its value as text, 32 bits."""
    h = 0
    for key in sorted(options):
        value = options[key]
        shown = ("true" if value else "false") if isinstance(value, bool) else "null" if value is None else str(value)
        for c in utf16_units(key) + utf16_units(shown):
            h = (h * 33 & U32) ^ c
    return h


def estimate_tokens(text: Column) -> Column:
    """ceil(characters / 3)."""
    return F.ceil(F.length(text) / F.lit(float(CHARS_PER_TOKEN))).cast("long")


def truncate_tokens(text: Column, tokens: int) -> Column:
    """The first ``tokens`` estimated tokens."""
    return F.substring(text, 1, tokens * CHARS_PER_TOKEN)


def truncate_to_context(text: Column, limit: int) -> Column:
    """The first four fifths of a context of ``limit`` tokens."""
    return truncate_tokens(text, limit * 8 // 10)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable_vector(v: Column, dim: int) -> Column:
    """Of the right length, without null or NaN, not all zero. Null is not usable."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine of a vector column with one query vector, whose norm is computed once here."""
    q = [float(x) for x in query]
    size = sum(x * x for x in q) ** 0.5
    return dot(v, constant(q)) / (norm(v) * F.lit(size))


def l2_normalize(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))))


def placeholder_embedding(text: Column, dim: int) -> Column:
    """A vector made from the text's hash: a Lehmer sequence, closed form, scaled to length 1.

    The i-th number of the sequence is seed * 16807^i mod (2^31 - 1), so no element waits for
    the one before.
    """
    m = 2147483647
    powers, p = [], 1
    for _ in range(dim):
        p = p * 16807 % m
        powers.append(p)
    rest = djb2a(text) % F.lit(m)
    seed = F.when(rest == 0, F.lit(1).cast("bigint")).otherwise(rest)
    row = constant(powers).cast("array<bigint>")
    raw = let(seed, lambda s: F.transform(row, lambda p: (((s * p) % F.lit(m)) / F.lit(float(m)) * 2 - 1).cast("float")))
    return let(raw, lambda r: F.transform(l2_normalize(r), lambda x: x.cast("float")))


def file_type_multiplier(path: Column) -> Column:
    """Weight by the end of the file's name, 1 if it has none of the known ends."""
    end = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.coalesce(F.element_at(constant(fixed.FILE_TYPE_MULTIPLIERS), end), F.lit(1.0))


def identifier_boost(matches: Column, boost: float = 1.5) -> Column:
    return F.lit(1.0) + matches * F.lit(boost - 1.0)


def rrf(ranks: list[Column], k: int = 60, weights: list[float] | None = None) -> Column:
    """Reciprocal-rank sum; a null rank adds nothing."""
    weights = weights or [1.0] * len(ranks)
    return reduce(lambda a, b: a + b, (F.coalesce(F.lit(w) / (k + r), F.lit(0.0)) for w, r in zip(weights, ranks)))
