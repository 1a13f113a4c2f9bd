"""Vector, keyword, literal and fused search, as lazy plans.

Exact vector search and literal search take any table of chunks; keyword and fused search take a
``SearchIndex`` (``operators/index.py``). Scores are reduced to slim rows (id, score) before
anything is shuffled; text is fetched for the few best ids at the end. A repeated id counts
once. Scores are rounded before they are ranked, and ties go to the smaller id, so that results
don't depend on the layout. Null texts match nothing; unusable vectors take no part.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed, scalar, text

RRF_K = 60
DECIMALS = 6


def _rank(by: list[Column]) -> Column:
    """Rank over all rows of a result of bounded size (a top-k list)."""
    return F.row_number().over(Window.orderBy(*by))


def _restrict(chunks: DataFrame, path_prefix: str | None) -> DataFrame:
    return chunks if path_prefix is None else chunks.where(F.col("file_path").startswith(path_prefix))


def hydrate(keys: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("file_path", "start_line", "end_line", "chunk_text")) -> DataFrame:
    """``keys`` (a top-k list with column id) with columns of their chunks, one row per key."""
    wanted = chunks.select("id", *columns).join(F.broadcast(keys.select("id")), "id", "left_semi").dropDuplicates(["id"])
    return keys.join(wanted, "id")


def knn(chunks: DataFrame, query: list[float], k: int, path_prefix: str | None = None) -> DataFrame:
    """(id, similarity, rank): the k chunks of greatest cosine with ``query``.

    The filter comes before the search, so no hit inside the prefix is lost. Vectors of another
    length, all zero or with NaN are skipped.
    """
    good = _restrict(chunks, path_prefix).where(scalar.usable_vector(F.col("embedding"), len(query)))
    scored = good.select("id", F.round(scalar.cosine_to(F.col("embedding"), query), DECIMALS).alias("similarity")).groupBy("id").agg(F.max("similarity").alias("similarity"))
    best = scored.orderBy(F.desc("similarity"), "id").limit(k)
    return best.withColumn("rank", _rank([F.desc("similarity"), F.col("id")]))


def vector_search(chunks: DataFrame, query: list[float], k: int, threshold: float, path_prefix: str | None = None) -> DataFrame:
    """The k best of the 2k nearest whose cosine reaches the threshold."""
    return knn(chunks, query, 2 * k, path_prefix).where(F.col("similarity") >= threshold).where(F.col("rank") <= k)


def context_preview(body: Column, query: str, around: int = 2) -> Column:
    """Lines that hold the query, with ``around`` lines before and after; gaps as a line of dots; the whole text if no line does."""
    low = F.lit(query.lower())

    def shown(lines: Column) -> Column:
        hit = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(F.lower(F.get(lines, i)), low))
        keep = F.array_sort(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(F.lit(0), i - around), F.least(F.size(lines) - 1, i + around))))))
        dots = lambda k: F.transform(k, lambda i: F.concat(F.when((i > F.element_at(k, 1)) & ~F.array_contains(k, i - 1), F.lit("...\n")).otherwise(F.lit("")), F.get(lines, i)))
        return F.array_join(scalar.let(keep, dots), "\n")

    return scalar.let(scalar.let(F.split(body, "\n"), shown), lambda p: F.when(p == "", body).otherwise(p))


def literal_search(chunks: DataFrame, query: str, k: int = 20, path_part: str | None = None) -> DataFrame:
    """(id, file_path, start_line, end_line, similarity, preview): chunks that hold the query, whatever the case.

    The path restriction means "contains". In order of path and line, then id. Texts are searched in the
    scan; only ids and places are put together and ordered, and the k texts are fetched at the end.
    """
    rows = chunks.where(F.contains(F.lower("chunk_text"), F.lit(query.lower())))
    if path_part is not None:
        rows = rows.where(F.col("file_path").contains(path_part))
    places = rows.select("id", "file_path", "start_line").groupBy("id").agg(F.min(F.struct("file_path", "start_line")).alias("p")).select("id", "p.file_path", "p.start_line")
    first = places.orderBy("file_path", "start_line", "id").limit(k)
    found = hydrate(first.select("id"), chunks).orderBy("file_path", "start_line", "id")
    return found.select("id", "file_path", "start_line", "end_line", F.lit(1.0).alias("similarity"), context_preview(F.col("chunk_text"), query).alias("preview"))


def fuse(hits: DataFrame, wv: float = 0.4, wb: float = 0.3) -> DataFrame:
    """Two ranked lists, put together by id, combined by (file_path, start_line).

    ``hits`` (of bounded size) has id, file_path, start_line, vector_rank and word_rank, either null
    where a list doesn't hold the chunk. Of several rows of a list with the same key the worst rank
    counts; the row is the last of the vector list, or else the first of the other. Gives ``hits``'
    columns with the ranks that count, and rrf. With no vector hit at all the rows stay as they are.
    """
    none = F.max("vector_rank").over(Window.partitionBy()).isNull()
    rest = [c for c in hits.columns if c not in ("vector_rank", "word_rank")]
    marked = hits.withColumn("_own", F.when(none, F.col("id")))
    g = marked.groupBy("file_path", "start_line", "_own").agg(
        F.max("vector_rank").alias("vector_rank"), F.max("word_rank").alias("word_rank"),
        F.max_by(F.struct(*rest), "vector_rank").alias("_v"), F.min_by(F.struct(*rest), "word_rank").alias("_b"),
    )
    r = F.coalesce("_v", "_b")
    return g.select(*(r.getField(c).alias(c) for c in rest), "vector_rank", "word_rank", scalar.rrf([F.col("vector_rank"), F.col("word_rank")], RRF_K, [wv, wb]).alias("rrf"))


def both_lists(index, query: str, query_vector: list[float], n: int, path_prefix: str | None, stemmed: bool = True, exact: bool = True) -> DataFrame:
    """The n best of vector and keyword search by id, with their chunks: at most 2n rows."""
    near = index.knn(query_vector, n, path_prefix, exact=exact).select("seg", "id", F.col("rank").alias("vector_rank"))
    said = index.bm25(query, n, path_prefix, stemmed).select("seg", "id", F.col("rank").alias("word_rank"), F.col("similarity").alias("bm25_score"))
    return index.fetch(near.join(said, ["seg", "id"], "full_outer"), "file_path", "start_line", "end_line", "chunk_text").drop("seg")


def hybrid_search(
    index, query: str, query_vector: list[float], k: int = 10, threshold: float = 0.35, path_prefix: str | None = None,
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3), identifier_boost: float = 1.5, stemmed: bool = True, exact: bool = True,
) -> DataFrame:
    """(id, file_path, start_line, end_line, chunk_text, similarity, rank) of a ``SearchIndex``: fused search.

    Weighted reciprocal ranks of the 2k best of both lists, boosted by identifiers shared with
    the query and by the type of file, divided by the greatest score; below ``threshold``
    nothing is shown. Equal scores go by vector rank, then word rank. If no vector is found at
    all, the keyword list is the result, with its own scores and whatever the threshold.
    """
    fused = fuse(both_lists(index, query, query_vector, 2 * k, path_prefix, stemmed, exact), weights[0], weights[1])
    wanted = text.identifiers_of(query)
    shared = F.size(F.array_intersect(text.extract_identifiers(F.col("chunk_text")), scalar.constant(wanted)))
    score = F.col("rrf") * scalar.identifier_boost(shared, identifier_boost) * scalar.file_type_multiplier(F.col("file_path")) * F.lit(weights[2])
    one = Window.partitionBy()
    scored = fused.withColumn("score", score).withColumn("best", F.max("score").over(one)).withColumn("none", F.max("vector_rank").over(one).isNull())
    relative = F.round(F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.lit(0.0)), DECIMALS)
    result = scored.withColumn("similarity", F.when(F.col("none"), F.col("bm25_score")).otherwise(relative)).where(F.col("none") | (F.col("similarity") >= threshold))
    order = [F.desc("similarity"), F.col("vector_rank").asc_nulls_last(), F.col("word_rank").asc_nulls_last(), F.col("id")]
    ranked = result.withColumn("rank", _rank(order)).where(F.col("rank") <= k)
    return ranked.select("id", "file_path", "start_line", "end_line", "chunk_text", "similarity", "rank")


def keyword_search(index, query: str, k: int, path_prefix: str | None = None, stemmed: bool = True) -> DataFrame:
    """(id, file_path, start_line, end_line, chunk_text, similarity, rank): keyword search alone; a query that expands to nothing is taken by its prefixes."""
    found = index.bm25(query, k, path_prefix, stemmed) if text.query_phrases(query) else index.prefix_bm25(query, k, path_prefix)
    return index.fetch(found, "file_path", "start_line", "end_line", "chunk_text").drop("seg")


def vector_search_index(index, query_vector: list[float], k: int, threshold: float, path_prefix: str | None = None, exact: bool = True) -> DataFrame:
    """(id, file_path, start_line, end_line, chunk_text, similarity, rank): of the 2k nearest those above the threshold, at most k."""
    near = index.knn(query_vector, 2 * k, path_prefix, exact=exact).where((F.col("similarity") >= threshold) & (F.col("rank") <= k))
    return index.fetch(near, "file_path", "start_line", "end_line", "chunk_text").drop("seg")


def preview(body: Column, tokens: int = 150) -> Column:
    """Beginning of a chunk, its first declaration in front if it doesn't begin with one."""
    lines = F.split(body, "\n")
    first = F.element_at(F.filter(lines, lambda s: F.length(F.trim(s)) > 0), 1)
    declared = F.get(F.filter(lines, lambda s: s.rlike(fixed.DECLARATION)), F.lit(0))
    shown = F.when(F.coalesce(F.size(F.filter(lines, lambda s: F.length(F.trim(s)) > 0)) > 0, F.lit(False)) & F.coalesce(first.rlike(fixed.DECLARATION), F.lit(False)), body)
    return scalar.truncate_tokens(shown.when(declared.isNull(), body).otherwise(F.concat(F.trim(declared), F.lit("\n...\n"), body)), tokens)


def heuristic_rerank(results: DataFrame, query: str) -> DataFrame:
    """Results (rank, similarity, chunk_text, ...) with ``rerank_score`` and ``new_rank``.

    A quarter each for shared words and for identifiers found, a fifth for the exact query, 0.15
    for the similarity, 0.1 for a keyword score if ``bm25_score`` is there, 0.05 for the place.
    """
    import re

    words = list(dict.fromkeys(w for w in re.sub(r"[^\w\s]", " ", query.lower(), flags=re.A).split() if len(w) > 2))
    names = [w.lower() for w in re.findall(r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", query) if len(w) > 2]
    low = F.lower("chunk_text")
    terms = F.array_distinct(F.filter(F.split(F.regexp_replace(low, r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 2))
    overlap = F.size(F.array_intersect(terms, scalar.constant(words))) / F.lit(float(len(words))) if words else F.lit(0.0)
    found = reduce(lambda a, b: a + b, (F.contains(low, F.lit(n)).cast("int") for n in names), F.lit(0)) / F.lit(float(max(1, len(names))))
    parts = re.split(r"\s+", query.lower())
    some = reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in parts if len(w) > 3), F.lit(0)) / F.lit(float(len(parts)))
    exact = F.when(F.contains(low, F.lit(query.lower())), F.lit(1.0)).otherwise(some)
    if "bm25_score" in results.columns:
        s = F.coalesce(F.col("bm25_score"), F.lit(0.0))
        keyword = F.when(s != 0, 1 / (1 + F.abs(s))).otherwise(F.lit(0.0))
    else:
        keyword = F.lit(0.0)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.when(total <= 1, F.lit(1.0)).otherwise(1 - (F.col("rank") - 1) / total * 0.5)
    score = overlap * 0.25 + found * 0.25 + exact * 0.2 + F.coalesce(F.col("similarity"), F.lit(0.0)) * 0.15 + keyword * 0.1 + place * 0.05
    scored = results.withColumn("rerank_score", F.round(score, DECIMALS))
    return scored.withColumn("new_rank", _rank([F.desc("rerank_score"), F.col("rank")]))


def cross_rerank(results: DataFrame, query: str, score, max_tokens: int = 512) -> DataFrame:
    """Results with ``rerank_score`` of a pair scorer ``score(query, texts) -> logits`` through a sigmoid, and ``new_rank``.

    The scorer runs in Arrow batches on the executors; texts are cut to ``max_tokens``.
    """
    import pandas as pd

    def logits(batches):
        for texts in batches:
            yield pd.Series([float(x) for x in score(query, texts.tolist())])

    logits.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    logits = F.pandas_udf(logits, "double")
    scored = results.withColumn("_t", F.coalesce(scalar.truncate_tokens(F.col("chunk_text"), max_tokens), F.lit(""))).withColumn("rerank_score", F.round(scalar.sigmoid(logits("_t")), DECIMALS)).drop("_t")
    return scored.withColumn("new_rank", _rank([F.desc("rerank_score"), F.col("rank")]))


def as_json(results: DataFrame, query: str, mode: str) -> DataFrame:
    """One row with the result list as JSON: query, mode and matches with file, lines, similarity and preview."""
    match = F.struct(
        F.col("rank"), F.col("file_path").alias("file"), F.concat_ws("-", F.col("start_line"), F.col("end_line")).alias("lines"),
        F.format_string("%.3f", "similarity").alias("similarity"), preview(F.col("chunk_text")).alias("preview"),
    )
    rows = results.agg(F.array_sort(F.collect_list(match)).alias("m"))  # a top-k list
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(mode).alias("mode"), F.transform("m", lambda e: e.dropFields("rank")).alias("matches"))).alias("json"))
