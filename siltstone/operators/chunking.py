"""Cutting files into line ranges: at units of code, and by size with overlapping lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.scalar import CHARS_PER_TOKEN

SIGNIFICANT = ("function", "class", "interface")


def effective_limit(max_tokens: int = 512, context_limit: int | None = None) -> tuple[int, int]:
    """(tokens, characters) of a chunk: no more than four fifths of the context."""
    tokens = max_tokens if context_limit is None else min(max_tokens, context_limit * 8 // 10)
    return tokens, tokens * CHARS_PER_TOKEN


def file_end(path: Column) -> Column:
    """What stands behind the last point of a path, in lower case; the whole path if there is none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def line_kind(line: Column, end: Column) -> Column:
    """Kind of boundary a line is: function, class, interface, other, import, or null."""
    js = F.coalesce(
        *(F.when(line.rlike(p), "function") for p in fixed.JS_FUNCTIONS),
        F.when(line.rlike(fixed.JS_CLASS), "class"), F.when(line.rlike(fixed.JS_INTERFACE), "interface"), *(F.when(line.rlike(p), F.when(line.contains("interface"), "interface").when(line.contains("class"), "class").otherwise("other")) for p in fixed.JS_OTHER),
    )
    kind = F.when(end.isin(*fixed.JS_ENDS), js)
    for ends, patterns in fixed.LANGUAGE_PATTERNS.items():
        kind = kind.when(end.isin(*ends), F.coalesce(*(F.when(line.rlike(p), k) for k, p in patterns)))
    return F.coalesce(kind, F.when(line.rlike(fixed.IMPORT), "import"), F.when(line.rlike(fixed.COMMENT), "comment"))


def boundaries(files: DataFrame, key: str, path: str, body: str) -> DataFrame:
    """(key, line_no, kind) of the lines at which something begins. Null texts have none."""
    lines = files.select(F.col(key), file_end(F.col(path)).alias("end"), F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return lines.select(key, "line_no", line_kind(F.col("line"), F.col("end")).alias("kind")).where(F.col("kind").isNotNull())


def segments(files: DataFrame, key: str, path: str, body: str) -> DataFrame:
    """(key, segment, start_line, end_line, text): a file cut before its functions, classes and interfaces.

    The first segment starts at line 0 and takes in what stands before the first unit; a file
    without one is a single segment. Blank segments are left out. It all happens inside the row:
    no shuffle.
    """
    lines = F.split(F.col(body), "\n")
    rows = files.where(F.col(body).isNotNull()).select(F.col(key), lines.alias("l"), file_end(F.col(path)).alias("e"))
    marks = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.coalesce(line_kind(F.get("l", i), F.col("e")).isin(*SIGNIFICANT), F.lit(False)))
    rows = rows.withColumn("m", marks)
    starts = F.when(F.size("m") > 0, F.concat(F.array(F.lit(0)), F.slice("m", 2, 2147483647))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("s", starts)
    each = F.transform("s", lambda s, i: F.struct(i.alias("segment"), s.alias("start_line"), (F.coalesce(F.get("s", i + 1), F.size("l")) - 1).alias("end_line")))
    cut = rows.select(key, "l", F.inline(each))
    out = cut.select(key, "segment", "start_line", "end_line", F.array_join(F.slice("l", F.col("start_line") + 1, F.col("end_line") - F.col("start_line") + 1), "\n").alias("text"))
    return out.where((F.col("start_line") <= F.col("end_line")) & F.col("text").rlike(r"\S"))


def _tokens(s: str) -> int:
    return -(-len(s) // CHARS_PER_TOKEN)


def shorten(text: str, limit: int) -> str:
    """Whole lines up to about ``limit`` characters (line breaks aren't counted); a long first line is cut."""
    if len(text) <= limit:
        return text
    kept = ""
    for line in text.split("\n"):
        if len(kept) + len(line) > limit:
            break
        kept = f"{kept}\n{line}" if kept else line
    return kept[:limit] or text[:limit]


def chunk_lines(lines: list[str], max_tokens: int, overlap_tokens: int, max_chars: int) -> list[tuple[str, int, int]]:
    """(text, start_line, end_line) of chunks filled greedily with lines.

    A full chunk is closed before the line that would exceed it, and its last
    ceil(overlap / 20) lines open the next. No overlap repeats no line. What a chunk holds beyond
    ``max_chars`` is lost, as with a single line longer than that.
    """
    repeat = -(-overlap_tokens // 20) if overlap_tokens > 0 else 0
    out, held, start, size = [], [], 0, 0

    def close() -> None:
        body = "\n".join(held)
        if body.strip():
            body = shorten(body, max_chars)
            out.append((body, start, start + body.count("\n")))

    for i, line in enumerate(lines):
        need = _tokens(line)
        if held and size + need > max_tokens and "\n".join(held):
            close()
            held = held[-repeat:] if repeat else []
            start, size = i - len(held), _tokens("\n".join(held))
        held.append(line)
        size += need
    if held:
        close()
    return [c for c in out if c[0].strip()]


def line_kind_of(line: str, end: str) -> str | None:
    """``line_kind`` for one line, outside of a plan."""
    if end in fixed.JS_ENDS:
        tests = [*(("function", p) for p in fixed.JS_FUNCTIONS), ("class", fixed.JS_CLASS), ("interface", fixed.JS_INTERFACE), *(("other", p) for p in fixed.JS_OTHER)]
    else:
        tests = next((list(ps) for ends, ps in fixed.LANGUAGE_PATTERNS.items() if end in ends), [])
    tests += [("import", fixed.IMPORT), ("comment", fixed.COMMENT)]
    return next((k for k, p in tests if re.search(p, line, re.A)), None)


def chunk_file(text: str | None, path: str | None, max_tokens: int = 512, overlap_tokens: int = 32, context_limit: int | None = None) -> list[tuple[str, int, int]]:
    """(text, start_line, end_line) of a file's chunks: its units, those too large cut by size."""
    if not text:
        return []
    tokens, chars = effective_limit(max_tokens, context_limit)
    lines = text.split("\n")
    end = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ("" if not path else path.lower())
    marks = [i for i, line in enumerate(lines) if line_kind_of(line, end) in SIGNIFICANT]
    if not marks:
        return chunk_lines(lines, tokens, overlap_tokens, chars)
    starts, out = [0, *marks[1:]], []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        body = "\n".join(lines[a:b])
        if not body.strip():
            continue
        if _tokens(body) > tokens:
            out += [(t, a + s, a + e) for t, s, e in chunk_lines(lines[a:b], tokens, overlap_tokens, chars)]
        else:
            out.append((body, a, b - 1))
    return out


def chunk_files(
    files: DataFrame, key: str, path: str, body: str, max_tokens: int = 512, overlap_tokens: int = 32, context_limit: int | None = None, by_size_only: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, the columns ``keep``, chunk_index, start_line, end_line, text) of all files. Filling depends on the lines before, so it runs in Arrow batches of Python."""
    names = [key, *keep, "chunk_index", "start_line", "end_line", "text"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, chars = effective_limit(max_tokens, context_limit)
        for pdf in batches:
            rows = []
            for p, t, *mine in pdf.itertuples(index=False, name=None):
                found = chunk_lines(t.split("\n"), tokens, overlap_tokens, chars) if by_size_only and t else chunk_file(t, p, max_tokens, overlap_tokens, context_limit)
                rows += [(*mine, i, s, e, x) for i, (x, s, e) in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    given = files.select(F.col(path).alias("_path"), F.col(body).alias("_body"), key, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(key, *keep).schema) + ", chunk_index int, start_line int, end_line int, text string"
    return given.mapInPandas(cut, schema)


def invalid_chunks(chunks: DataFrame) -> DataFrame:
    """(id, problem) of chunks with a negative start, an end before the start, or a blank text."""
    problem = F.when(F.col("start_line") < 0, "negative start").when(F.col("end_line") < F.col("start_line"), "end before start").when(~F.coalesce(F.col("chunk_text").rlike(r"\S"), F.lit(False)), "blank text")
    return chunks.select("id", problem.alias("problem")).where(F.col("problem").isNotNull()).distinct()
