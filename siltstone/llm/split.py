"""Problem 4: splitting oversized chunks at natural boundaries.

A hierarchy of separators (section, paragraph, line, sentence, word, character) is tried
from the top: the piece under construction is filled greedily up to the limit and cut at
the last boundary of the highest level that leaves it reasonably full; if a level has no
such boundary the next one is taken. Each following piece starts with the last two lines
of the one before, as far as the limit allows; behind a cut inside a long line it starts with the
line's last words instead, and without words with its last characters. Pieces are slices of the text: leaving out
the repeated part, they join to the text again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3
MAX_TOKENS = 512
OVERLAP_LINES = 2
#: Share of a piece that is repeated where no whole line can be.
PART = 16
#: A cut of a level counts if it leaves the piece at least this full.
FILL = 0.5

_SECTION = regex.compile(r"\n(?=#{1,6}\s|[=\-]{4,}\r?\n|(?:export\s+|pub\s+|public\s+|private\s+|static\s+|async\s+|abstract\s+)*(?:class|interface|function|def|func|fn|impl|struct|enum|trait|module|namespace)\b)")
_PARAGRAPH = regex.compile(r"\n(?:[ \t]*\r?\n)+")
_LINE = regex.compile(r"\n")
_SENTENCE = regex.compile(r"[.!?;…]+[\"'”’»)\]]*\s+|[。！？；]+[」』”）]*|।\s*")
_WORD = regex.compile(r"\s+|[,;{}()\[\]]")
_LEVELS = (_SECTION, _PARAGRAPH, _LINE, _SENTENCE, _WORD)


def boundaries(text: str) -> list[list[int]]:
    """Positions at which each level may cut, ascending: always before the next unit's first character."""
    return [sorted({m.end() for m in level.finditer(text) if 0 < m.end() < len(text)}) for level in _LEVELS]


def _cut(levels: list[list[int]], start: int, end: int) -> int:
    """The best cut in (start, end]."""
    least = start + max(1, int(FILL * (end - start)))
    for cuts in levels:
        k = bisect_right(cuts, end) - 1
        if k >= 0 and cuts[k] >= least:
            return cuts[k]
    for cuts in levels[2:]:  # none is near the end: the latest of the finer ones, if there is any
        k = bisect_right(cuts, end) - 1
        if k >= 0 and cuts[k] > start:
            return cuts[k]
    return end


def _overlap(text: str, lines: list[int], words: list[int], before: int, cut: int, lines_kept: int, limit: int) -> int:
    """Where the next piece starts so that it repeats up to ``lines_kept`` lines before ``cut``, of which the last may be cut itself.

    The limit allows lines beside which the next line fits too (or, if that is very long, half a
    piece of new text). If no line fits, the last PART of a piece is repeated, from the beginning of
    a word if there is one. All of the piece before, which began at ``before``, is never repeated.
    """
    k = bisect_right(lines, cut - 1)  # starts of lines before the cut
    end = text.find("\n", cut)
    need = min((end + 1 if end >= 0 else len(text)) - cut, limit // 2)
    for n in range(lines_kept, 0, -1):
        at = lines[k - n] if k >= n else 0
        if k >= n - 1 and before < at < cut and cut - at + need <= limit:
            return at
    if not lines_kept:
        return cut
    least = max(before + 1, cut - limit // PART, lines[k - lines_kept] if k >= lines_kept else 0)
    j = bisect_right(words, least - 1)
    return min(words[j], cut) if j < len(words) and words[j] < cut else min(least, cut)


def split_spans(text: str, limit: int = MAX_TOKENS * CHARS_PER_TOKEN, overlap_lines: int = OVERLAP_LINES) -> list[tuple[int, int, int]]:
    """(start, new, end) of each piece: the slice is text[start:end], text[start:new] repeats the one before.

    Every slice is at most ``limit`` characters. The empty text gives one empty piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    levels, out, start, new = boundaries(text), [], 0, 0
    lines = levels[2]
    while True:
        if n - start <= limit:
            out.append((start, new, n))
            return out
        cut = _cut(levels, new, start + limit)
        out.append((start, new, cut))
        start = _overlap(text, lines, levels[4], start, cut, overlap_lines, limit)
        new = cut


_PIECES = "piece_index int, piece_text string, start_char int, new_char int, end_char int, start_line int, end_line int"


def _pieces(batches: Iterator[pd.DataFrame], limit: int, overlap_lines: int) -> Iterator[pd.DataFrame]:
    """Rows (text, first line, further columns) to their pieces, the further columns in front."""
    for pdf in batches:
        rows = []
        for text, first, *mine in pdf.itertuples(index=False, name=None):
            base = None if pd.isna(first) else int(first)
            for k, (a, new, b) in enumerate(split_spans(text, limit, overlap_lines)):
                # the line break at a cut belongs to neither piece's text
                shown = text[a:b] if b == len(text) else text[a:b].removesuffix("\n").removesuffix("\r") if text[b - 1] == "\n" else text[a:b]
                s = e = None
                if base is not None:
                    s = base + text.count("\n", 0, a)
                    e = s + shown.count("\n")
                rows.append((*mine, k, shown, a, new, b, s, e))
        out = pd.DataFrame(rows, columns=[*pdf.columns[2:], "piece_index", "piece_text", "start_char", "new_char", "end_char", "start_line", "end_line"])
        yield out.astype({"start_line": "Int32", "end_line": "Int32"})


def _cut_rows(big: DataFrame, keep: list[str], max_tokens: int, overlap_lines: int) -> DataFrame:
    given = big.select("chunk_text", F.col("start_line").cast("int").alias("start_line"), *keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*keep).schema) + ", " + _PIECES
    return given.mapInPandas(lambda it: _pieces(it, max_tokens * CHARS_PER_TOKEN, overlap_lines), schema)


def is_oversized(text, max_tokens: int = MAX_TOKENS):
    """ceil(characters / 3) above the limit, characters being code points of the whole text."""
    return F.ceil(F.length(text) / F.lit(float(CHARS_PER_TOKEN))) > max_tokens


def split_oversized(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_lines: int = OVERLAP_LINES) -> DataFrame:
    """Pieces of the chunks above the limit: one row per piece.

    Columns id, piece_index (from 0), piece_text, start_char, new_char, end_char, start_line,
    end_line. ``chunks`` needs id, chunk_text, start_line; others are ignored. A null text is
    not oversized; a null start_line gives null lines. Repeated ids count once. Only oversized
    rows leave the JVM or are shuffled.
    """
    big = chunks.where(is_oversized(F.col("chunk_text"), max_tokens) & F.col("id").isNotNull()).select("id", "chunk_text", "start_line")
    return _cut_rows(big.dropDuplicates(["id"]), ["id"], max_tokens, overlap_lines)


def running_start(df: DataFrame, keys: list[str], order: list[str], block: str, count: str, name: str, width: int = 256) -> DataFrame:
    """Sum of ``count`` over the rows before each row within ``keys`` by ``order``, without one task per key.

    ``block`` is the non-negative integer column that leads ``order``. Counts are summed up by blocks
    of ``width`` of its values; the few block sums are summed up to offsets, and rows are summed
    only inside their block. A key with a third of all rows thus spreads over many tasks.
    """
    from pyspark.sql import Window

    blocked = df.withColumn("_block", F.floor(F.coalesce(F.col(block), F.lit(0)) / width))
    counts = blocked.groupBy(*keys, "_block").agg(F.sum(count).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block") == F.col("_b")]
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.join(offsets, on)
    return joined.withColumn(name, (F.col("_before") + F.coalesce(F.sum(count).over(inside), F.lit(0))).cast("int")).select(*df.columns, name)


def rechunk(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap_lines: int = OVERLAP_LINES) -> DataFrame:
    """All chunks with none above the limit, ``chunk_index`` running anew within each file version.

    A version is a path and a hash. Chunks within the limit stay as they are (piece_index 0). Texts
    are shuffled once, by id; the running numbers are made of slim rows that say how many pieces
    each chunk gives, and come back to the texts by id.
    """
    from siltstone.llm.dedupe import one_row_per_id

    limit = max_tokens * CHARS_PER_TOKEN

    @F.pandas_udf("int")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([len(split_spans(t, limit, overlap_lines)) for t in texts], dtype="int32")

    names = ["id", "file_path", "file_hash", "chunk_index", "chunk_text", "start_line", "end_line"]
    rows = one_row_per_id(chunks.select(*names, *(["updated_at"] if "updated_at" in chunks.columns else []))).select(*names)
    big = F.coalesce(is_oversized(F.col("chunk_text"), max_tokens), F.lit(False))
    slim = ["id", "file_path", "file_hash", "chunk_index"]
    counted = rows.where(~big).select(*slim, F.lit(1).alias("n")).unionByName(rows.where(big).select(*slim, pieces("chunk_text").alias("n")))
    first = running_start(counted, ["file_path", "file_hash"], ["chunk_index", "id"], "chunk_index", "n", "first").select("id", "first")
    placed = rows.join(first, "id")
    kept = placed.where(~big).select("id", "file_path", "file_hash", F.col("chunk_index").alias("old_index"), F.lit(0).alias("piece_index"), "chunk_text", "start_line", "end_line", F.col("first").alias("chunk_index"))
    cut = _cut_rows(placed.where(big).withColumnRenamed("chunk_index", "old_index"), ["id", "file_path", "file_hash", "old_index", "first"], max_tokens, overlap_lines)
    cut = cut.select("id", "file_path", "file_hash", "old_index", "piece_index", F.col("piece_text").alias("chunk_text"), "start_line", "end_line", (F.col("first") + F.col("piece_index")).cast("int").alias("chunk_index"))
    return kept.unionByName(cut)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks above 512 estimated tokens: those that the splitter cut."""
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    return split_oversized(chunks).where(F.col("piece_index") == 0).select("id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, oversized ones as pieces, with running indexes."""
    return rechunk(spark.read.parquet(f"{sf_dir}/chunks.parquet"))


SQL = {"p4_found": "SELECT DISTINCT id FROM chunks WHERE ceil(length(chunk_text) / 3.0) > 512"}
