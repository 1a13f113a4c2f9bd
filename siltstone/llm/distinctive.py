"""Problem 2: how distinctive each term is of its record.

For a term that occurs y times among the n of a record and Y times among the N of the whole
collection, the log-odds of record against rest are taken with an informative Dirichlet prior,
whose pseudo-counts are the collection's shares: alpha = STRENGTH * Y / N. Divided by the
standard error they give z-scores: high for terms that are rare elsewhere, near zero or below
for those found everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.dedupe import one_row_per_id
from siltstone.session import written

#: Sum of the prior's pseudo-counts.
STRENGTH = 500.0
#: More terms than this are never broadcast.
HOT_TERMS = 20_000
_SPLIT = r"[^\p{L}\p{N}_]+"


def terms(text: Column, more: Column | None = None) -> Column:
    """Lower-case words of a text (letters, digits, underscore) and of the names beside it, with repeats."""
    both = F.concat_ws(" ", text, *([more] if more is not None else []))
    return F.filter(F.split(F.lower(both), _SPLIT), lambda w: w != "")


def term_scores(records: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("chunk_text", "identifiers"), strength: float = STRENGTH) -> DataFrame:
    """(id, term, tf, z): every term of every record with its count there and its z-score.

    Repeated ids count once, here and in the collection's counts, the latest row by ``updated_at`` if
    there is such a column; null ids are dropped. Null and empty texts have no terms. If the record
    is the whole collection, z compares it with the prior alone.

    The text is shuffled once, by id, and its terms are counted once and written down. The
    collection's counts are summed on the map side. Terms with more than a HOT_TERMS-th of all rows
    come back to the rows by a broadcast: there are fewer than HOT_TERMS of them, whatever the data.
    The others, of which none is hot, are joined by term.
    """
    more = [c for c in ("updated_at",) if c in records.columns and c not in text_cols]
    rows = one_row_per_id(records.select(id_col, *text_cols, *more), id_col)
    words = rows.select(F.col(id_col).alias("id"), terms(F.col(text_cols[0]), F.concat_ws(" ", *text_cols[1:]) if len(text_cols) > 1 else None).alias("w"))
    counted = words.select("id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = written(counted, "terms")
    counts = written(tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("rows")), "counts")
    whole = counts.agg(F.sum("total").alias("size"), F.sum("rows").alias("rows")).first()  # one row
    size, limit = float(whole["size"] or 0), (whole["rows"] or 0) / HOT_TERMS
    hot = counts.where(F.col("rows") > limit).select("term", "total")
    here = tf.join(F.broadcast(hot), "term", "left")
    cold = here.where(F.col("total").isNull()).drop("total").join(counts.where(F.col("rows") <= limit).select("term", "total"), "term")
    joined = here.where(F.col("total").isNotNull()).unionByName(cold)
    y, n, whole_term, size = F.col("tf").cast("double"), F.col("n").cast("double"), F.col("total").cast("double"), F.lit(size)
    alpha = F.lit(strength) * whole_term / size
    rest, n_rest = whole_term - y, size - n
    others, rest_others = n + F.lit(strength) - y - alpha, n_rest + F.lit(strength) - rest - alpha
    odds = F.log((y + alpha) / others) - F.log((rest + alpha) / rest_others)
    # in a collection of a single term the odds have no denominator: such a term tells nothing
    z = F.when((others > 0) & (rest_others > 0), odds / F.sqrt(1 / (y + alpha) + 1 / (rest + alpha))).otherwise(F.lit(0.0))
    return joined.select("id", "term", F.col("tf").cast("long").alias("tf"), F.round(z, 6).alias("z"))


def distinctive_terms(records: DataFrame, k: int = 10, **how) -> DataFrame:
    """(id, term, tf, z, rank): the k most distinctive terms of each record; equal scores by term."""
    from pyspark.sql import Window

    by = Window.partitionBy("id").orderBy(F.desc("z"), "term")
    return term_scores(records, **how).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all terms of all chunks."""
    return term_scores(spark.read.parquet(f"{sf_dir}/chunks.parquet"))


SQL = {
    "p2_scores": r"""
WITH one AS (SELECT id, any_value(chunk_text) AS t, any_value(identifiers) AS i FROM chunks WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', t, coalesce(i, ''))), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM one),
e AS (SELECT id, len(w) AS n, unnest(w) AS term FROM w),
tf AS (SELECT id, n, term, count(*) AS y FROM e GROUP BY id, n, term),
c AS (SELECT term, sum(y)::DOUBLE AS c FROM tf GROUP BY term),
s AS (SELECT sum(c) AS s FROM c),
a AS (SELECT id, term, y AS tf, y::DOUBLE AS y, n::DOUBLE AS n, c, s, 500.0::DOUBLE * c / s AS a FROM tf JOIN c USING (term), s)
SELECT id, term, tf,
  round((ln((y + a) / (n + 500.0::DOUBLE - y - a)) - ln((c - y + a) / (s - n + 500.0::DOUBLE - (c - y) - a))) / sqrt(1 / (y + a) + 1 / (c - y + a)), 6) AS z
FROM a
"""
}
