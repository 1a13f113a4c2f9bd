"""Statistics about the index, its caches and its runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar, text


def index_stats(chunks: DataFrame) -> DataFrame:
    """(files, chunks, mean_chunks): one row; repeated ids count once."""
    one = chunks.groupBy("id").agg(F.max("file_path").alias("file_path"))
    return one.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks")).withColumn("mean_chunks", F.round(F.col("chunks") / F.greatest(F.lit(1), F.col("files")), 6))


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(file_path) in order, each once."""
    return chunks.select("file_path").where(F.col("file_path").isNotNull()).distinct().orderBy("file_path")


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    """(file_path, chunks) of every file; repeated ids count once."""
    return chunks.select("file_path", "id").distinct().groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """(name, n, least, most, mean) per name in lower case without blanks around; null and NaN values are left out."""
    good = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


def cache_stats(metrics: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate): samples of the names cache_hits and cache_misses, one row; the rate is 0 without any."""
    name = F.lower(F.trim("name"))
    counted = metrics.agg(F.count(F.when(name == "cache_hits", 1)).alias("hits"), F.count(F.when(name == "cache_misses", 1)).alias("misses"))
    return counted.withColumn("hit_rate", F.round(F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(F.lit(0.0)), 6))


def keep_latest(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest n rows by the columns ``order``, greatest first; a top-n, not a sort of all rows."""
    return log.orderBy(*(F.desc_nulls_last(c) for c in order)).limit(n)


def throughput(runs: DataFrame, amount: str, milliseconds: str) -> DataFrame:
    """Adds per_second: the amount over the time, which counts as a thousandth of a second at least."""
    return runs.withColumn("per_second", F.round(F.col(amount) / F.greatest(F.col(milliseconds) / 1000.0, F.lit(0.001)), 6))


def term_frequencies(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf): words of each text and their counts."""
    return documents.select(key, F.explode(text.fts_tokens(F.col(body))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def mean_pool(vectors: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, pooled): mean of the usable vectors of each group, scaled to length 1.

    One average per dimension, summed partially before the shuffle; a group of any size is a
    row of ``dim`` numbers per task.
    """
    good = vectors.where(scalar.usable_vector(F.col(vector), dim))
    means = good.groupBy(group).agg(*(F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)))
    return means.select(group, F.transform(scalar.l2_normalize(F.array(*(F.col(f"_{i}") for i in range(dim)))), lambda x: F.round(x, 6)).alias("pooled"))


def bm25_tf(documents: DataFrame, key: str, body: str, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score): sum over the query's words of ln(1 + (k1 + 1) tf / (k1 (1 - b + b dl / mean) + tf)), a repeated word twice.

    Without idf. Texts without a word of the query have no row.
    """
    import re

    words = [w for w in re.split(r"[\W_]+", query.lower(), flags=re.A) if len(w) > 1]
    tokens = documents.select(key, text.fts_tokens(F.col(body)).alias("w")).where(F.size("w") > 0)
    mean = tokens.agg(F.coalesce(F.avg(F.size("w")), F.lit(1.0)).alias("mean")).select("mean").scalar()
    tf = lambda w: F.size(F.filter("w", lambda x: x == w)).cast("double")
    part = lambda t: F.log1p((k1 + 1) * t / (k1 * (1 - b + b * F.size("w") / F.col("mean")) + t))
    score = F.lit(0.0)
    for w in words:
        score = score + part(tf(w))
    return tokens.withColumn("mean", mean).select(key, F.round(score, 6).alias("score")).where(F.col("score") > 0)


def normalize_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``norm``: the score over the greatest one, at most 1; 0 if that is 0. The maximum is a scalar subquery."""
    most = scores.agg(F.coalesce(F.max(score), F.lit(0.0)).alias("most")).select("most").scalar()
    share = F.when(F.col("_most") > 0, F.round(F.least(F.lit(1.0), F.col(score) / F.col("_most")), 6)).otherwise(F.lit(0.0))
    return scores.withColumn("_most", most).withColumn("norm", share).drop("_most")
